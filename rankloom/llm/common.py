"""What the operators share: Arrow text as numpy arrays, hashes of spans, and joins on skewed keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_stored, shared_dir, stored  # noqa: F401

#: Bytes of text that one numpy block holds; a longer single text makes a block of its own.
BLOCK_BYTES = 2 << 20
#: Rows of an Arrow batch of whole texts. Such a batch stands in the JVM, while it grows twice, and in Python, for each task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session's Arrow batches have at most so many rows (a smaller setting stays); results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column, not copied; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    held, data = column.buffers()[1:]
    if not len(column) or held is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(held, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: first row, bytes, and offsets from 0."""
    data, offsets = text_arrays(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's code points and its row offsets counted in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, none over a row's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(len(inside) + 1, bool)
    head[offsets] = True  # the first position of each row, and the end
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | head[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | head[1:])) + 1
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 21)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it stands. Equal hashes call for an exact comparison."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD1342543DE82EF95) + words[j : j + n]
    return mix(total)


#: A key that more than this share of the rows has is hot; there are fewer than 1 / HOT such keys.
HOT = 1e-3


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key and, in the column weight, how many rows of left have it.

    Keys with over max(100, HOT * total) rows are fewer than 1 / HOT, so their rows of right are broadcast and
    their rows of left stay where they are; only the other keys are shuffled. weight is dropped.
    """
    limit = max(100, int(total * HOT))
    hot = right.where(F.col(weight) > limit).drop(weight).withColumn("_hot", F.lit(True))
    cold = right.where(F.col(weight) <= limit).drop(weight)
    marked = left.join(F.broadcast(hot), key, "left")
    rest = marked.where("_hot is null").select(left.columns).join(cold, key, how)
    return marked.where("_hot").drop("_hot").unionByName(rest)
