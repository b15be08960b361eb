"""Benchmark decontamination by a prefix-filtered set join of word shingles, verified exactly."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, gram_hashes, runs, span_hashes, stored

#: Words of a shingle, and the benchmark windows that one pass over the documents holds in each task.
SHINGLE, WINDOWS = 5, 100_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and the first word of each row (one more than rows)."""
    low = _LOWER[data]
    starts, ends = runs(_WORD[low], offsets)
    return low, starts, ends, np.searchsorted(starts, offsets)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as split_words finds them."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low, starts, ends, _ = split_words(raw, np.array([0, len(raw)]))
    return [low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = 10) -> DataFrame:
    """(window, n, items): distinct windows of consecutive item words joined by one space, and whose they are.

    An item of fewer words, but not none, is one window. Items with a null id count as the item ''.
    """

    def made(out: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["window", "n", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = [], [], []
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text)
                for at in range(max(1, len(found) - words + 1) if found else 0):
                    one = found[at : at + words]
                    for column, value in zip(out, (b" ".join(one), len(one), item), strict=True):
                        column.append(value)
                    if len(out[0]) >= 8192:  # however long an item is
                        yield made(out)
                        out = [], [], []
        yield made(out)

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "window binary, n int, item string").groupBy("window", "n").agg(F.collect_set("item").alias("items"))


class Grams:
    """The grams of a set of lengths as sorted hashes, with a bitmap before the search."""

    def __init__(self, by_length: dict[int, np.ndarray]):
        self.by_length = {k: np.unique(v) for k, v in by_length.items()}
        self.mask = np.uint64((1 << max(16, min(24, 5 + max(len(v) for v in by_length.values()).bit_length()))) - 1 if by_length else 1)
        self.maps = {}
        for k, v in self.by_length.items():
            self.maps[k] = np.zeros(int(self.mask) + 1, bool)
            self.maps[k][v & self.mask] = True

    def find(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that hold one of the grams of length k, and its index."""
        known = self.by_length[k]
        at = np.flatnonzero(self.maps[k][hashes & self.mask])
        index = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        same = known[index] == hashes[at]
        return at[same], index[same]


def _window_grams(window: bytes, shingle: int) -> tuple[int, np.ndarray]:
    """The length of a window's shingles (its own, if shorter) and their hashes in order."""
    raw = np.frombuffer(window, np.uint8)
    _, starts, ends, _ = split_words(raw, np.array([0, len(raw)]))
    k = min(shingle, len(starts))
    return k, gram_hashes(span_hashes(raw, starts, ends), k)


def _in_row(found: np.ndarray, k: int, first: np.ndarray) -> np.ndarray:
    """Which grams of k words, by their first word, do not leave their row."""
    row = np.searchsorted(first, found, "right") - 1
    return found + k <= first[row + 1]


def gram_counts(docs: DataFrame, text_col: str, grams: Grams) -> dict[int, np.ndarray]:
    """How often each gram stands in the whole of docs; each task sends one row for each gram that it met."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = {k: np.zeros(len(v), np.int64) for k, v in known.by_length.items()}
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                low, starts, ends, first = split_words(data, offsets)
                hashes = span_hashes(low, starts, ends)
                for k in known.by_length:
                    at, index = known.find(k, gram_hashes(hashes, k))
                    np.add.at(total[k], index[_in_row(at, k, first)], 1)
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(v[at])], names=["k", "at", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in grams.by_length.items()}
    for k, at, n in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n")).collect():
        out[k][at] = n  # as many rows as grams of this block of windows, at most
    return out


class Prefixes:
    """Windows by their rarest shingle, the one prefix token that containment of all shingles needs."""

    def __init__(self, windows: list[tuple[bytes, int, list[str]]], counts: dict[int, np.ndarray], grams: Grams, shingle: int):
        by_gram: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.windows = [w.split(b" ") for w, _, _ in windows]
        self.items = [i for _, _, i in windows]
        for w, (window, _, _) in enumerate(windows):
            k, hashes = _window_grams(window, shingle)
            rarity = counts[k][np.searchsorted(grams.by_length[k], hashes)]
            p = min(range(len(hashes)), key=lambda j: (rarity[j], int(hashes[j])))
            by_gram[k][int(hashes[p])].append((w, p))
        self.grams = Grams({k: np.array(list(v), np.uint64) for k, v in by_gram.items()})
        self.lists = {k: [by_gram[k][int(h)] for h in v] for k, v in self.grams.by_length.items()}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        """Words of each row; and for rows with a hit their hit spans (first word in the row, end) and windows."""
        low, starts, ends, first = split_words(data, offsets)
        hashes = span_hashes(low, starts, ends)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        found: dict[int, set[int]] = defaultdict(set)
        for k, lists in self.lists.items():
            at, index = self.grams.find(k, gram_hashes(hashes, k))
            rows = np.searchsorted(first, at, "right") - 1
            for i, g, row in zip(at.tolist(), index.tolist(), rows.tolist(), strict=True):
                for w, p in lists[g]:
                    window = self.windows[w]
                    s = i - p
                    e = s + len(window)
                    # Length and position: the window must fit into the document around this shingle.
                    if s >= first[row] and e <= first[row + 1] and all(low[starts[s + j] : ends[s + j]].tobytes() == window[j] for j in range(len(window))):
                        spans[row].append((s - int(first[row]), e - int(first[row])))
                        found[row].add(w)
        return np.diff(first), spans, found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order with the same union."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_HITS = "n_words long, spans array<struct<s:long,e:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _matched(docs: DataFrame, id_col: str, text_col: str, prefixes: Prefixes, only_hits: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at, data, offsets in blocks(batch.column(2)):
                n_words, spans, found = known.scan(data, offsets)
                keep = sorted(spans) if only_hits else range(len(n_words))
                rows = pa.array([at + r for r in keep], pa.int64())
                made = [[{"s": s, "e": e} for s, e in merge(spans[r])] if r in spans else [] for r in keep]
                items = [sorted({i for w in found[r] for i in known.items[w]}) if r in found else [] for r in keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(n_words[list(keep)] if only_hits else n_words, pa.int64()), pa.array(made, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, {_HITS}")


def prefix_passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, words: int, shingle: int, windows_per_pass: int) -> Iterator[tuple[int, Prefixes]]:
    """The number of passes, and the prefixes of each pass's windows by their rarity in docs."""
    windows = stored(benchmark_windows(benchmark, item_col, "text", words))
    passes = max(1, -(-windows.count() // windows_per_pass))
    part = F.pmod(F.xxhash64("window"), F.lit(passes))
    for k in range(passes):
        own = [(bytes(w), c, i) for w, c, i in windows.where(part == k).collect()]  # about windows_per_pass
        by_length: dict[int, list[np.ndarray]] = defaultdict(list)
        for w, _, _ in own:
            length, hashes = _window_grams(w, shingle)
            by_length[length].append(hashes)
        grams = Grams({length: np.concatenate(v) for length, v in by_length.items()})
        yield passes, Prefixes(own, gram_counts(docs, text_col, grams) if own else {}, grams, shingle)


def kept(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", words: int = 10, shingle: int = SHINGLE, windows_per_pass: int = WINDOWS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark window (see benchmark_hits)."""
    at = docs.columns.index(text_col)

    def clean(known) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for first, data, offsets in blocks(batch.column(at)):
                    good[[first + r for r in known.value.scan(data, offsets)[1]]] = False
                yield batch.filter(pa.array(good))

        return run

    for passes, prefixes in prefix_passes(docs, benchmark, text_col, item_col, words, shingle, windows_per_pass):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(prefixes)), docs.schema)
        docs = stored(docs) if passes > 1 else docs
    return docs


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", words: int = 10, shingle: int = SHINGLE, windows_per_pass: int = WINDOWS) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of docs: where benchmark windows occur, and of which items.

    A window is `words` consecutive words of an item, or all of a shorter item. spans are disjoint half-open
    ranges of document words inside an occurrence; items are sorted as strings. Words are runs of digits,
    letters a-z (A-Z are lower-cased) and non-ASCII characters.

    Method: a window's shingles are its set; as all of them must occur, one prefix token is enough, and the
    rarest in the whole corpus (counted in a first pass) is taken. Documents are probed for prefix tokens
    only; length and position of the token bound where the window can stand, and the words there are compared
    exactly, so that hash collisions change nothing.

    A pass holds at most windows_per_pass distinct windows in each task. A larger benchmark takes several
    passes, each over all documents, whose hits are joined by (doc_id, hash of the text).

    Null and empty texts have no words and no hits, also as items. Repeated rows stay repeated. An empty
    benchmark gives no hits, an empty docs no rows. Other columns are ignored.
    """
    out = None
    for passes, prefixes in prefix_passes(docs, benchmark, text_col, item_col, words, shingle, windows_per_pass):
        hits = _matched(docs, id_col, text_col, prefixes, only_hits=passes > 1)
        if passes == 1:
            return hits.drop("text_hash")
        hits = stored(hits.dropDuplicates(["doc_id", "text_hash"]))
        out = hits if out is None else out.unionByName(hits)
    merged = out.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumn("spans", F.expr("""aggregate(array_sort(spans), cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) ->
        if(size(a) > 0 and x.s <= element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))), concat(a, array(x))))"""))
    every = _matched(docs, id_col, text_col, Prefixes([], {}, Grams({}), shingle), only_hits=False).select("doc_id", "text_hash", "n_words")
    joined = every.alias("d").join(merged.alias("m"), F.expr("d.doc_id <=> m.doc_id and d.text_hash = m.text_hash"), "left")
    return joined.select("d.doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def op8_digest(hits: DataFrame) -> DataFrame:
    """The contract's columns from benchmark_hits."""
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: The same rows in DuckDB's SQL.
ORACLE = r"""
with w as (
  select item_id::varchar as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null
), win as (
  select distinct item, least(10, len(ws)) as n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') as g
  from (select item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as p from w where len(ws) > 0)
), d as (
  select doc_id, row_number() over () as rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents
), pos as (
  select rid, n, p, array_to_string(ws[p : p + n - 1], ' ') as g
  from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d, (select distinct n from win) where len(ws) >= n)
), hit as (
  select rid, item, p, pos.n from pos join win on pos.g = win.g and pos.n = win.n
), cover as (
  select rid, count(distinct x) as n_hit from (select rid, unnest(range(p, p + n)) as x from hit) group by rid
), items as (
  select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as list from hit group by rid
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (rid) left join items using (rid)
"""
