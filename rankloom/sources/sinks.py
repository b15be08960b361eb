"""Run folders, reports, and the embedding cache."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..functions.text import product_text
from ..operators.report import markdown
from ..operators.scorers import encode_texts
from .readers import load_products


def write_text(spark: SparkSession, path: str, value: str, overwrite: bool = False) -> None:
    """A small text file wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, overwrite)
    out.write(bytearray(value.encode()))
    out.close()


def load_template(path: str) -> tuple[str, str]:
    """A prompt template and the sha256 of its bytes."""
    with open(path, "rb") as f:
        raw = f.read()
    return raw.decode(), hashlib.sha256(raw).hexdigest()


def run_id(model: str, now: dt.datetime | None = None) -> str:
    """A run's name from its UTC start."""
    return f"{(now or dt.datetime.now(dt.timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}-{model}"


def write_run(runs_dir: str, name: str, manifest: dict, per_user: DataFrame, scores: DataFrame, errors: dict[str, int] | None = None) -> str:
    """A run folder: per_user and scores as Parquet, errors and the manifest as JSON, the manifest last, so a broken run has none."""
    spark, at = per_user.sparkSession, f"{runs_dir.rstrip('/')}/{name}"
    per_user.write.mode("errorifexists").parquet(f"{at}/per_user.parquet")
    scores.write.mode("errorifexists").parquet(f"{at}/scores.parquet")
    if errors:
        write_text(spark, f"{at}/errors.json", json.dumps(errors, sort_keys=True))
    write_text(spark, f"{at}/manifest.json", json.dumps(manifest | {"run_id": name}, sort_keys=True, default=str))
    return at


def write_csv(table: DataFrame, path: str, *order: str) -> None:
    """A small result (a grid, channels, diagnostics, a screen) as one CSV file with a header, in the order of the columns given."""
    (table.orderBy(*order) if order else table).coalesce(1).write.mode("overwrite").csv(path, header=True)


#: Head of the table of models, the primary metric's name to fill in (a fixed value: readers look for it).
BOARD_HEAD = "| Model | {} | Δ vs L1 [CI] | p (Holm) | Beats L1 |"


def write_leaderboard(board: DataFrame, path: str, primary: str = "ndcg@10") -> str:
    """The board (a row for each model) as CSV and Markdown at path.csv and path.md; returns the Markdown."""
    write_csv(board, path + ".csv", F.desc(f"`{primary}`"), "model")
    lines = [BOARD_HEAD.format(primary), "|" + "---|" * 5, *[r.line for r in markdown(board, primary).orderBy("place").collect()]]
    text = "".join(x + "\n" for x in lines)
    write_text(board.sparkSession, path + ".md", text, overwrite=True)
    return text


def write_split(processed: str, split: str, cohort: DataFrame, positives: DataFrame, top: DataFrame) -> None:
    """A split as readers.load_split finds it: the cohort, and its users' positives with is_rating5 (1 for those in top)."""
    own = positives.join(cohort.select("user_id"), "user_id", "left_semi")
    marked = own.join(top.select("user_id", "item_id").distinct().withColumn("is_rating5", F.lit(1)), ["user_id", "item_id"], "left").withColumn("is_rating5", F.coalesce("is_rating5", F.lit(0)))
    cohort.write.mode("overwrite").parquet(f"{processed}/cohort_{split}")
    marked.write.mode("overwrite").parquet(f"{processed}/positives_{split}")


def write_products(spark: SparkSession, raw: str, path: str, locale: str = "us") -> DataFrame:
    """(product_id, text) of a locale's products, the first row of an id, written at path; returns one row of what was written.

    count and empty_text are of all; the quantiles of the text's length in characters are of every tenth
    product by a draw of its id.
    """
    load_products(spark, raw, locale).select("product_id", product_text(True).alias("text")).write.mode("overwrite").parquet(path)
    n = F.length("text")
    tenth = F.when(draw(F.lit("length"), F.col("product_id")) % 10 == 0, n)
    return spark.read.parquet(path).agg(F.count("*").alias("count"), F.percentile(tenth, F.lit(0.5)).alias("text_chars_median"), F.percentile(tenth, F.lit(0.95)).alias("text_chars_p95"), F.count_if(n == 0).alias("empty_text"))


def write_report(spark: SparkSession, path: str, **facts: DataFrame | int | float | str) -> dict:
    """A JSON report of one-row tables and plain values."""
    out = {}
    for k, v in facts.items():
        out[k] = v.first().asDict(recursive=True) if isinstance(v, DataFrame) else v
    write_text(spark, path, json.dumps(out, default=str, sort_keys=True), overwrite=True)
    return out


def cache_key(rows: DataFrame, id_col: str, text_col: str, encoder: str) -> str:
    """A key that changes with the encoder, the ids and the texts, not with order or partitions."""
    each = F.sha2(F.to_json(F.struct(F.col(id_col), F.col(text_col)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(each, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.lit(encoder), *lanes, F.count("*").cast("string")), 256)).first()[0]


def half(v: Column) -> Column:
    """An array's numbers rounded to half precision: 11 bits, in floats."""
    step = lambda x: F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step(x)) * step(x)).cast("float"))


def cached_vectors(rows: DataFrame, id_col: str, text_col: str, encoder: str, make: Callable[[], Callable], cache_dir: str, half_precision: bool = False) -> DataFrame:
    """(id, v) from the cache, or encoded once and written there, in half precision if asked. Both ways give what was written."""
    encoder = encoder + ":half" if half_precision else encoder
    spark = rows.sparkSession
    at = f"{cache_dir.rstrip('/')}/{cache_key(rows, id_col, text_col, encoder)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        found = encode_texts(rows, id_col, text_col, make)
        (found.withColumn("v", half(F.col("v"))) if half_precision else found).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
