"""The canonical views: provided tables under the names of a ranking benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction log (user_id, item_id, rating, ts, l_orderkey, l_linenumber): events after an item's release."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    joined = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    released = F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(l_partkey % 100 * 24 as int))")
    return joined.where(F.col("o_orderdate") >= released).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.least(F.lit(5), 1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("rating"),
        F.col("o_orderdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, title, categories, store, price, size) of every item."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.array("p_type").alias("categories"),
        F.col("p_brand").alias("store"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v, label) with double elements."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, v): item i has vector i modulo their number."""
    v = vectors(spark, sf_dir)
    n = v.agg(F.count("*").alias("n"))
    keyed = items(spark, sf_dir).select("item_id").crossJoin(n).select("item_id", (F.col("item_id") % F.col("n")).alias("vec_id"))
    return keyed.join(v, "vec_id").select("item_id", "v")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, v, qlabel): every 25th vector is a query."""
    return vectors(spark, sf_dir).where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "v", F.col("label").alias("qlabel"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, product_id, label, gain): about every seventh pair is judged by the distance of the labels.

    The rule fixes a product's residue for each query, so pairs come from an equality join.
    """
    q = search_queries(spark, sf_dir).select("query_id", "qlabel", F.pmod(-F.col("query_id") * 31, F.lit(7)).alias("k"))
    p = vectors(spark, sf_dir).select(F.col("vec_id").alias("product_id"), "label", (F.col("vec_id") % 7).alias("k"))
    apart = F.abs(F.col("qlabel") - F.col("label"))
    label = F.when(apart == 0, "E").when(apart == 1, "S").when(apart == 2, "C").otherwise("I")
    gains = F.create_map(*[x for k, v in schemas.GAINS.items() for x in (F.lit(k), F.lit(v))])
    return q.join(p, "k").where("query_id <> product_id").select("query_id", "product_id", label.alias("label")).withColumn("gain", gains[F.col("label")])
