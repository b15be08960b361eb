"""Shards of nearly equal bytes by a histogram sort: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: A splitter may miss its target by this share of a shard (of a range, for those within a shard).
TOLERANCE, RANGE_TOLERANCE = 0.001, 0.1
#: Bytes that a range aims at, how few ranges a shard has, and how many all shards have together; bits of the key that a round of probes resolves.
RANGE_BYTES, FEWEST_RANGES, MOST_RANGES = 64 << 20, 32, 1 << 16
FIRST_BITS, NEXT_BITS = 14, 8
#: Bits of the key that are the text's hash; the rest are the id's.
TEXT_BITS = 40
_OFFSET = 1 << 63


def sort_key(id_col: str, text_col: str) -> Column:
    """A long by which rows are sorted: TEXT_BITS of the text's hash, then the id's hash.

    Rows of one text stand together (texts whose first TEXT_BITS agree by chance, one pair in 2**40, are
    mixed), and yet a group of any size is spread over 2**24 keys, so it can be split: copies at the edge of
    a range go to both sides.
    """
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    low = 64 - TEXT_BITS
    return F.shiftleft(F.shiftrightunsigned(text, low), low).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(7)), TEXT_BITS))


def _table(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """Equally long lists of integers as a table of longs: one literal each, no rows from the driver's Python."""
    one = spark.range(1).select(*[_longs(v).alias(k) for k, v in columns.items()])
    return one.select(F.explode(F.arrays_zip(*columns)).alias("x")).select("x.*")


def _located(keys: DataFrame, low: int, step: int, wanted: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(t, first key, bytes before it in its interval, bytes) of the sub-interval that each wanted target falls in.

    wanted has, by target, its interval (the key's bits from low on) and the bytes that are below the target
    within it. Each interval is probed at 2**step equally spaced keys: one aggregation counts the exact bytes
    between probes, summed within each partition first; a window runs over the 2**step counts of an interval
    and hands on only the count that holds a target. So the driver gets a row for each target.
    """
    spark = keys.sparkSession
    prefix = F.shiftright("key", low) if low < 64 else F.lit(0).cast("long")
    rows = keys.select(prefix.alias("p"), F.shiftright("key", low - step).alias("b"), "size")
    open_ = _table(spark, t=list(wanted), p=[p for p, _ in wanted.values()], goal=[g for _, g in wanted.values()])
    if low < 64:  # MOST_RANGES rows at most
        rows = rows.join(F.broadcast(open_.select("p").distinct()), "p", "left_semi")
    counts = rows.groupBy("p", "b").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto).join(F.broadcast(open_), "p").where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("size") < F.col("goal")))
    return [tuple(r) for r in placed.select("t", "b", F.col("upto") - F.col("size"), "size").collect()]


def splitters(keys: DataFrame, targets: list[int], slack: list[int]) -> list[int]:
    """For each target the smallest key of the range behind it, such that the bytes below meet the target.

    Probes are equally spaced keys: 2**FIRST_BITS over all keys, then 2**NEXT_BITS within each interval that
    still holds an unmet target (_located). A target whose nearest probe misses by its slack at most is met.
    Rows of one key cannot be parted: such an interval ends the search.
    """
    out = {t: -_OFFSET for t, goal in enumerate(targets) if goal <= 0}
    open_ = {t: (0, 0) for t in range(len(targets)) if t not in out}  # target: interval, bytes below the interval
    low, step = 64, FIRST_BITS
    while open_:
        found = _located(keys, low, step, {t: (p, targets[t] - below) for t, (p, below) in open_.items()})
        low -= step
        step = min(NEXT_BITS, low)
        again = {}
        for t, b, before, size in found:
            at = open_[t][1] + before
            under, over = targets[t] - at, at + size - targets[t]
            if under <= slack[t] and under <= over or not low and under <= over:
                out[t] = b << low
            elif over <= slack[t] or not low:
                out[t] = min((b + 1) << low, _OFFSET - 1)
            else:
                again[t] = (b, at)
        open_ = again
    # Splitters in order: a hot key's neighbours may share one.
    ordered, last = [], -_OFFSET
    for t in range(len(targets)):
        last = max(last, out[t])
        ordered.append(last)
    return ordered


def _longs(values: list[int]) -> Column:
    """One literal array (folded once by the optimizer); none here is longer than MOST_RANGES."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(key: str, edges: list[int]) -> Column:
    """How many of the sorted edges are at most the key: a binary search in one array literal."""
    if not edges:
        return F.lit(0).cast("long")
    widths = [1 << k for k in reversed(range(len(edges).bit_length()))]
    known = _longs(edges)
    return F.aggregate(_longs(widths), F.lit(0).cast("long"), lambda low, w: F.when(F.get(known, (low + w - 1).cast("int")) <= F.col(key), low + w).otherwise(low))


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with size, text_crc32, shard and slot: n_shards shards of nearly equal bytes, in key order.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 the unsigned crc32 of these bytes (null: of
    none). Shards' bytes differ from equal by TOLERANCE of a shard and one row, but where rows of one key
    (same id hash and text) are more than that: those stay together. slot counts a shard's rows from 0
    without a gap in order of the key, then the id (see sort_key for where equal texts stand). Empty docs give no rows, fewer
    rows than shards leave shards empty; repeated rows are rows of their own; a null id is hashed as such.
    Columns of docs with the names of the new ones are replaced.

    Method: keys and sizes (16 bytes a row) are written to the shared folder; splitters() probes them; then
    the rows are exchanged once, by range. Each shard is several ranges, of equal bytes too, so that no task
    has to hold a shard: a slot is the rows in the ranges before plus the place in its own range. A range aims at
    range_bytes; there are MOST_RANGES in all at most, which bounds what the driver and the plan hold, so past
    4 TB ranges grow in proportion (1.6 GB at 100 TB) and their sort spills.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    keys = stored(docs.select(sort_key(id_col, text_col).alias("key"), made["size"].alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    own = "_" * (1 + max([0, *(len(c) - len(c.lstrip("_")) for c in kept)]))  # begins no column of docs
    key, range_ = f"{own}key", f"{own}range"
    rows = docs.select(*kept, *[c.alias(k) for k, c in made.items()], sort_key(id_col, text_col).alias(key))
    if not total:
        return rows.select(*kept, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = max(1, min(MOST_RANGES // n_shards, max(FEWEST_RANGES, -(-total // (n_shards * range_bytes)))))
    n_ranges = n_shards * parts
    targets = [total * k // n_ranges for k in range(1, n_ranges)]
    slack = [int(TOLERANCE * total / n_shards) if k % parts == 0 else int(RANGE_TOLERANCE * total / n_ranges) for k in range(1, n_ranges)]
    edges = splitters(keys, targets, slack)
    ranged = keys.groupBy(range_of("key", edges).alias("r")).count().collect()
    sizes = {r: n for r, n in ranged}
    before, at = [], 0
    for r in range(n_ranges):
        at = 0 if r % parts == 0 else at
        before.append(at)
        at += sizes.get(r, 0)
    rows = rows.withColumn(range_, range_of(key, edges))
    place = F.row_number().over(Window.partitionBy(range_).orderBy(key, id_col))
    slot = F.get(_longs(before), F.col(range_).cast("int")) + place - 1
    return rows.withColumn("slot", slot).select(*kept, "size", "text_crc32", F.floor(F.col(range_) / parts).cast("int").alias("shard"), "slot")


def op10_rows(docs: DataFrame) -> DataFrame:
    """The contract's query."""
    out = shard(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
