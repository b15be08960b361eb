"""Deterministic draws and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    """A 32-bit integer from the md5 of the parts joined by ':', the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those of the smallest draws, ties by key."""
    return rows.orderBy(draw(F.lit(seed), F.col(key)), key).limit(n)


def row_digest(columns: list[str]) -> Column:
    """sha256 of a row's values as text; null is written apart from any value."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def content_digest(rows: DataFrame, group: str) -> DataFrame:
    """(digest, rows) of a table whatever its order, files and partitions: the digest of its groups' digests.

    Row digests are gathered within a group (say a user) first; groups' digests then add up, as numbers of
    60 bits in four lanes, so no task ever holds them all.
    """
    own = rows.select(F.col(group).alias("g"), row_digest(rows.columns).alias("d"))
    groups = own.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count("*").alias("n"))
    lanes = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return groups.agg(F.sha2(F.concat_ws(":", *lanes, F.coalesce(F.sum("n"), F.lit(0)).cast("string")), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def hash_embedding(rows: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """(id, v): a bag of words over md5 buckets plus 1e-6, as a unit vector. Empty texts give the even vector."""
    words = rows.select(id_col, F.explode_outer(F.filter(F.split(F.lower(text_col), r"(?U)\s+"), lambda w: w != "")).alias("w"))
    bucket = F.pmod(F.conv(F.right(F.md5("w"), F.lit(2)), 16, 10).cast("int"), F.lit(dims))
    counts = words.groupBy(id_col).agg(*[(F.count_if(bucket == k) + 1e-6).alias(f"d{k}") for k in range(dims)])
    raw = F.array(*[f"d{k}" for k in range(dims)])
    return counts.select(id_col, normalize(raw).alias("v"))


def normalize(v: Column) -> Column:
    """The vector over its length, which counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(F.array(F.struct(v.alias("v"), norm.alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]
