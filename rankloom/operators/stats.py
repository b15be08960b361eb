"""Paired bootstrap, Holm's correction and confidence intervals, with draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.hashing import draw
from ..storage import stored

#: Differences (users times models) that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def numbered(users: DataFrame, buckets: int = 256) -> DataFrame:
    """(user_id, i): a number from 0 without gaps, in order of (bucket of the id's md5, id).

    Ranks are taken within buckets and moved up by the buckets before, so only their counts meet in one task.
    """
    rows = users.select("user_id").distinct().withColumn("bucket", draw(F.lit("n"), F.col("user_id")) % buckets)
    before = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy("user_id")) - 1
    return rows.withColumn("own", own).join(before, "bucket").select("user_id", (F.coalesce("before", F.lit(0)) + F.col("own")).alias("i"))


def paired_bootstrap(diffs: DataFrame, n_resamples: int = schemas.N_RESAMPLES, seed: int = 0) -> DataFrame:
    """(model, b, mean): bootstrap means of paired differences from (model, user_id, diff).

    Users are numbered (see numbered); resample b draws position i as md5(seed:b:i) modulo their number, the same
    for all models. The users' differences are broadcast to the draws if they are few (their number is checked),
    so that a task sums its own draws and next to nothing is shuffled; otherwise draws are counted by user and
    joined. Neither users nor resamples gather in one task. Means are rounded to 12 places: sums of equal values in another order must not fall to either side of zero.
    """
    users = diffs.select("user_id").distinct()
    n = users.agg(F.count("*").alias("n"))
    draws = n.sparkSession.range(n_resamples).select(F.col("id").alias("b")).crossJoin(F.broadcast(n))  # n is one row
    draws = draws.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"), "n").select("b", (draw(F.lit(seed), F.col("b"), F.col("k")) % F.col("n")).alias("i"))
    values = stored(diffs.join(numbered(users), "user_id").select("i", "model", "diff"))
    if values.count() <= BROADCAST_ROWS:
        drawn = draws.join(F.broadcast(values), "i")
        return drawn.groupBy("model", "b").agg(F.round(F.sum("diff") / F.count("*"), 12).alias("mean"))
    counted = draws.groupBy("b", "i").agg(F.count("*").alias("times"))
    return counted.join(values, "i").groupBy("model", "b").agg(F.round(F.sum(F.col("diff") * F.col("times")) / F.sum("times"), 12).alias("mean"))


def bootstrap_p(boot: DataFrame) -> DataFrame:
    """(model, p): two-sided, smoothed by one, zeros on both sides."""
    left, right, n = F.count_if(F.col("mean") <= 0) + 1, F.count_if(F.col("mean") >= 0) + 1, F.count("*") + 1
    return boot.groupBy("model").agg(F.least(F.lit(1.0), 2 * F.least(left / n, right / n)).alias("p"))


def holm(rows: DataFrame, name: str = "model", p: str = "p") -> DataFrame:
    """rows with p_holm and ci_level: step-down adjusted p, monotone and at most 1, and each step's own level.

    One window over the family of tests, which is as long as there are models.
    """
    order = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    step = m - F.row_number().over(order) + 1
    capped = rows.withColumn("_step", step).withColumn("_c", F.least(F.lit(1.0), F.col("_step") * F.col(p)))
    out = capped.withColumn("p_holm", F.max("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out.withColumn("ci_level", 1 - F.lit(schemas.SIGNIFICANCE) / F.col("_step")).drop("_step", "_c")


def quantile_of(values: str, level: Column) -> Column:
    """The linear quantile of a sorted array at a level that may differ from row to row."""
    at = level * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(F.col(values), low), F.get(F.col(values), F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def compare_to_baseline(diffs: DataFrame, n_resamples: int = schemas.N_RESAMPLES, seed: int = 0) -> DataFrame:
    """(model, mean_diff, p, p_holm, ci_level, ci_low, ci_high, significant) from (model, user_id, diff)."""
    boot = stored(paired_bootstrap(diffs, n_resamples, seed))  # read three times
    tested = holm(bootstrap_p(boot))
    sorted_ = boot.groupBy("model").agg(F.array_sort(F.collect_list("mean")).alias("boot"))  # n_resamples numbers a model
    means = diffs.groupBy("model").agg(F.avg("diff").alias("mean_diff"))
    half = (1 - F.col("ci_level")) / 2
    out = tested.join(sorted_, "model").join(means, "model")
    return out.select("model", "mean_diff", "p", "p_holm", "ci_level", quantile_of("boot", half).alias("ci_low"), quantile_of("boot", 1 - half).alias("ci_high"), ((F.col("p_holm") < schemas.SIGNIFICANCE) & (F.col("mean_diff") > 0)).alias("significant"))
