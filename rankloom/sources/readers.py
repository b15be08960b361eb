"""Readers of raw logs, metadata and search tables, with declared schemas only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def load_ratings(spark: SparkSession, raw_dir: str, category: str) -> DataFrame:
    """The three parts of a rating log as one, tagged by split; of equal (user, item, time) the first in file order stays.

    File order is train, valid, test and the line within each; a gzip file is one task, so lines keep theirs.
    """
    parts = []
    for k, split in enumerate(("train", "valid", "test")):
        rows = spark.read.schema(schemas.RATINGS_CSV).csv(f"{raw_dir}/{category}.{split}.csv.gz", header=True)
        parts.append(rows.select("user_id", "parent_asin", "rating", "timestamp", F.lit(split).alias("source_split"), F.lit(k).alias("_k"), F.monotonically_increasing_id().alias("_line")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return keep_first(every, ["user_id", "parent_asin", "timestamp"], ["_k", "_line"]).drop("_k", "_line")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order, which should be total. min_by combines within each task first."""
    rest = [c for c in rows.columns if c not in key]
    packed = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return packed.select(*key, "_r.*").select(rows.columns)


def load_meta(spark: SparkSession, raw_dir: str, keep: DataFrame, category: str) -> DataFrame:
    """Metadata of the wanted items (keep: parent_asin), nine fields, absent ones null, first row of an id."""
    rows = spark.read.schema(schemas.META).json(f"{raw_dir}/meta_{category}.jsonl.gz").withColumn("_line", F.monotonically_increasing_id())
    return keep_first(rows.join(keep.select("parent_asin").distinct(), "parent_asin", "left_semi"), ["parent_asin"], ["_line"]).drop("_line")


def load_examples(spark: SparkSession, path: str, locale: str = "us") -> DataFrame:
    """Judged pairs of the small version and one locale; the query is trimmed of all Unicode white space."""
    rows = spark.read.schema(schemas.EXAMPLES).parquet(path).where((F.col("small_version") == 1) & (F.col("product_locale") == locale))
    return rows.drop("small_version").withColumn("query", F.regexp_replace("query", r"(?U)^\s+|\s+$", ""))


def load_products(spark: SparkSession, path: str, locale: str, ids: DataFrame | None = None) -> DataFrame:
    """Products of one locale, of the given ids only if there are any; of an id the first row in order of files and their rows."""
    rows = spark.read.schema(schemas.PRODUCTS).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).where(F.col("product_locale") == locale)
    if ids is not None:
        rows = rows.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    return keep_first(rows, ["product_id"], ["_file", "_row"]).drop("_file", "_row")


def load_split(spark: SparkSession, processed: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Cohort and positives of a split."""
    return spark.read.parquet(f"{processed}/cohort_{split}"), spark.read.parquet(f"{processed}/positives_{split}")


def load_runs(spark: SparkSession, runs_dir: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, per_user) of the runs that have both; the run is the folder's name."""
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:manifest\.json|per_user(?:\.parquet)?/[^/]+)$", 1)
    manifests = spark.read.schema(schemas.MANIFEST).json(f"{runs_dir}/*/manifest.json", multiLine=True).withColumn("run_id", run)
    per_user = spark.read.parquet(f"{runs_dir}/*/per_user.parquet").withColumn("run_id", run)
    both = manifests.select("run_id").join(per_user.select("run_id").distinct(), "run_id", "left_semi")
    return manifests.join(both, "run_id", "left_semi"), per_user.join(both, "run_id", "left_semi")
