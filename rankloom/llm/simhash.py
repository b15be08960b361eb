"""Near-duplicates by SimHash: tiles of fingerprints compared exactly with numpy's exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, skew_join, stored
from .components import connected_components

#: Fingerprints that a tile aims at. A block of bands holds as many tiles as it needs.
TILE = 1024


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text: majority bits of the XXH64 of its shingles, repeats included; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = len(words) - width + 1
    found = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), (starts[width:] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # so that a very long text takes no more memory than a short one
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, extra: Column | None = None) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. Null text has no words.

    With `extra`, a long, there is a third column of this name that carries it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for at, data, offsets in blocks(batch.column(1)):
                raw = data.tobytes()
                out[at : at + len(offsets) - 1] = [fingerprint(raw[s:e], width, seed) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    kind = docs.schema[id_col].dataType.simpleString()
    more = [] if extra is None else [extra.cast("long").alias("extra")]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)
    return rows.mapInArrow(run, f"doc_id {kind}, fp long" + (", extra long" if more else ""))


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int, side: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within radius: of left and right, or of left with itself (right None) once each.

    Both are sorted by population count and cut into small tiles; tiles whose population counts differ by
    more than the radius cannot hold such a pair and are skipped.
    """
    own = right is None
    i_order = np.argsort(np.bitwise_count(left), kind="stable")
    j_order = i_order if own else np.argsort(np.bitwise_count(right), kind="stable")
    a, b = left[i_order], (left if own else right)[j_order]
    pa_, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    for i in range(0, len(a), side):
        row, low, high = a[i : i + side, None], pa_[i], pa_[min(i + side, len(a)) - 1]
        for j in range(i if own else 0, len(b), side):
            to = min(j + side, len(b)) - 1
            if pb[j] - high > radius:
                break
            if low - pb[to] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(row ^ b[None, j : j + side]) <= radius)
            if own and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield i_order[x + i], j_order[y + j]


def forest(found: Iterator[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' spanning forest as (node, smallest node): as many rows as nodes at most, however many pairs there are."""
    nodes = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    label = np.arange(len(nodes))
    for x, y in found:
        y = y + shift
        while True:  # hook the larger root on the smaller, then halve paths, until every pair agrees
            rx, ry = label[x], label[y]
            if not (odd := rx != ry).any():
                break
            np.minimum.at(label, np.maximum(rx, ry)[odd], np.minimum(rx, ry)[odd])
            while not np.array_equal(label, up := label[label]):
                label = up
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


def _band(bits: int, radius: int, k: int) -> Column:
    """The lowest bits of the k-th of radius + 1 bands of the fingerprint."""
    edges = [round(64 * j / (radius + 1)) for j in range(radius + 2)]
    take = min(bits, edges[k + 1] - edges[k])
    return F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << take) - 1)).cast("int")


def fingerprint_links(distinct: DataFrame, n: int, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Edges (a, b) of the graph of distinct fingerprints at most radius bits apart, thinned to spanning forests.

    Two such fingerprints agree in at least one of radius + 1 bands of bits, so only tiles of one block
    (band, its lowest bits) have to meet; with few fingerprints no bit is taken and each block is everything.
    Blocks hold about one tile; a hot block is cut into tiles by population count (and, for a count that
    alone exceeds a tile, by a hash). Pairs of its tiles are tasks of their own, but for those whose
    population counts differ by more than the radius. Each pair within a task is compared exactly.
    """
    bits = max(0, min(64 // (radius + 1), (max(n, 1) // tile).bit_length()))
    # Bands serve only where they thin: one band with no bits already is everything.
    bands = range(radius + 1) if bits else range(1)
    rows = distinct.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.posexplode(F.array(*[_band(bits, radius, k) for k in bands])).alias("band", "bits"))
    rows = stored(rows)
    block = ["band", "bits"]
    counts = rows.groupBy(*block, "pc").count()
    # One struct for each population count of a block: 65 at most, whatever the block's size.
    ordered = counts.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("pc", "count"))).alias("pcs"), F.sum("count").alias("rows"))
    ordered = ordered.withColumn("tiles", F.expr(f"""
        aggregate(pcs, named_struct('at', 0L, 'out', cast(array() as array<struct<pc:int,first:long,parts:int>>)), (s, p) -> named_struct(
            'at', s.at + if(p.count > {tile}, 2 * {tile}L - pmod(s.at, {tile}L) + {tile}L * cast(ceil(p.count / {tile}) as long), p.count),
            'out', concat(s.out, array(named_struct('pc', p.pc,
                'first', if(p.count > {tile}, cast((s.at - pmod(s.at, {tile}L)) / {tile} as long) + 1, cast((s.at - pmod(s.at, {tile}L)) / {tile} as long)),
                'parts', if(p.count > {tile}, cast(ceil(p.count / {tile}) as int), 1)))))).out"""))
    small = ordered.where(F.col("rows") <= 2 * tile).select(*block)
    large = stored(ordered.where(F.col("rows") > 2 * tile).select(*block, F.explode("tiles").alias("t")).select(*block, "t.*"))
    # The tiles of hot blocks, and which pairs of them can hold a link.
    tiles = large.select(*block, "pc", F.explode(F.expr("sequence(first, first + parts - 1)")).alias("tile")).groupBy(*block, "tile").agg(F.min("pc").alias("low"), F.max("pc").alias("high"))
    other = tiles.select(*block, F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = tiles.join(other, block).where((F.col("tile") <= F.col("tile2")) & (F.col("low2") - F.col("high") <= radius) & (F.col("low") - F.col("high2") <= radius))
    pairs = pairs.select(*block, F.explode(F.expr("if(tile = tile2, array(struct(tile as t, tile as t1, tile as t2)), array(struct(tile as t, tile as t1, tile2 as t2), struct(tile2 as t, tile as t1, tile2 as t2)))")).alias("p")).select(*block, F.col("p.t").alias("tile"), "p.t1", "p.t2")
    tiled = rows.join(large, [*block, "pc"]).select("fp", *block, (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("tile"))
    hot = tiled.join(pairs, [*block, "tile"]).select(*block, "t1", "t2", (F.col("tile") == F.col("t1")).alias("is_left"), "fp")
    plain = rows.join(small, block).select(*block, F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(True).alias("is_left"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        fp, is_left = table.column("fp").to_numpy().view(np.uint64), table.column("is_left").to_numpy()
        left = fp[is_left]
        right = None if table.column("t1")[0].as_py() == table.column("t2")[0].as_py() else fp[~is_left]
        a, b = forest(close_pairs(left, right, radius), left, right)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return plain.unionByName(hot).groupBy(*block, "t1", "t2").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: groups of documents linked by fingerprints at most radius bits apart.

    component_id is the smallest doc_id reachable, the document's own included. Text is lower-cased in A-Z
    and split at ASCII white space. Null and empty texts have fingerprint zero and are linked like any
    other; a text of fewer than width words has one shingle. Repeated rows stay repeated; a null doc_id is
    kept and takes no part in the smallest (a component of null ids only has a null component_id). An empty
    table gives an empty one. Other columns are ignored.

    Only distinct fingerprints are compared, so exact copies cost one row. The result is joined to the
    documents through their fingerprint, hot fingerprints apart from the rest (skew_join).
    """
    fps = stored(fingerprints(docs, id_col, text_col, width, seed))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    n, rows = distinct.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    edges = stored(fingerprint_links(distinct.select("fp"), n, radius, tile))
    roots = connected_components(edges)
    # A node of the graph is one fingerprint; those without a link are their own root.
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named.where((F.col("copies") > 1) | F.col("root").isNotNull()).select("fp", "root", "first_id", "copies"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"), F.count("*").alias("weight"))
    joined = skew_join(named, least, "root", "weight", n).where((F.col("copies") > 1) | (F.col("members") > 1)).select("fp", "component_id", "copies")
    joined = stored(joined)
    out = skew_join(fps, joined, "fp", "copies", rows, "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, the same in every run; maps are hashed as JSON."""
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*plain)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """One row of each group of near-duplicates (see simhash_groups), all columns: that of the smallest doc_id.

    Groups are of rows, not of ids: rows with a null id or with an id that other texts have too are judged by
    their own text. Of a group a row with an id goes before one without, then the smaller id, then the smaller
    hash of the whole row; of rows alike in every column one stays. So exactly one row of each group is left,
    whatever the partitions. An empty table gives an empty one.

    A row is known by its id and row_hash, so the texts meet one verdict in one exchange; rows that are
    repeated as a whole take a second one, if there are any.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width, seed, row_hash(docs)))
    alike = rows.groupBy("fp", "doc_id", "extra").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("extra").alias("hash"), "n")
    distinct = stored(alike.groupBy("fp").agg(F.min(first).alias("first")))
    roots = connected_components(stored(fingerprint_links(distinct.select("fp"), distinct.count(), radius, tile)))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash", "first.n"))
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # begins no column of docs
    keys = chosen.select(F.col("doc_id").alias(f"{own}id"), F.col("hash").alias(f"{own}key"), "n")

    def taken(which: Column) -> DataFrame:
        mine = docs.withColumn(f"{own}hash", row_hash(docs))
        same = F.col(f"{own}hash").eqNullSafe(F.col(f"{own}key")) & F.col(f"`{id_col}`").eqNullSafe(F.col(f"{own}id"))
        return mine.join(keys.where(which).drop("n"), same, "left_semi")

    once = taken(F.col("n") == 1).select(*[f"`{c}`" for c in docs.columns])
    if not chosen.where("n > 1").head(1):
        return once
    many = taken(F.col("n") > 1).dropDuplicates([id_col, f"{own}hash"]).select(*[f"`{c}`" for c in docs.columns])
    return once.unionByName(many)


def hex_fingerprint(fp: str = "fp") -> Column:
    """16 lowercase hexadecimal digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
