"""Ranking metrics as one conditional aggregate over flat tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

BINARY = ("ndcg@10", "precision@10", "precision@30", "ndcg@30", "recall@10", "recall@30", "hit_rate@10", "hit_rate@30")
GRADED = ("p@10", "p@5", "p@10_es", "p@5_es", "p@10_judged", "p@5_judged", "judged@10", "ndcg@10", "recall@100")


def safe_score(score: str = "score") -> Column:
    """A missing or NaN score ranks last."""
    low = F.lit(float("-inf"))
    return F.coalesce(F.nanvl(F.col(score).cast("double"), low), low)


def ranked(scores: DataFrame, *keys: str, item: str = "item_id") -> DataFrame:
    """scores with new_rank from 0: score descending, ties by l1_rank, then the item."""
    place = F.row_number().over(Window.partitionBy(*(keys or ("user_id",))).orderBy(safe_score().desc(), "l1_rank", item)) - 1
    return scores.withColumn("new_rank", place.cast("long"))


def gain_at(rank: str, value: Column) -> Column:
    """value discounted by log2(rank + 2), rank from 0."""
    return value / F.log2(F.col(rank) + 2)


def ideal_dcg(k: int, n: Column) -> Column:
    """DCG of min(k, n) relevant items at the top."""
    if k <= 0:
        raise ValueError(f"a cut-off is positive, not {k}")
    sums = [0.0]
    for i in range(k):
        sums.append(sums[-1] + 1 / math.log2(i + 2))
    return F.get(F.array(*[F.lit(x) for x in sums]), F.least(F.lit(k), n).cast("int"))


def user_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """The BINARY metrics of each user from (user_id, new_rank, is_pos, n_pos).

    Denominators: k for precision, n_pos (all positives, in the list or not) for recall and the ideal.
    """
    keys = keys or ("user_id",)
    n = F.max("n_pos")
    hits = lambda k: F.count_if((F.col("is_pos") == 1) & (F.col("new_rank") < k))
    dcg = lambda k: F.sum(F.when((F.col("is_pos") == 1) & (F.col("new_rank") < k), gain_at("new_rank", F.lit(1.0))).otherwise(0.0))
    made = {}
    for k in (10, 30):
        made |= {f"ndcg@{k}": dcg(k) / ideal_dcg(k, n), f"precision@{k}": hits(k) / k, f"recall@{k}": hits(k) / n, f"hit_rate@{k}": (hits(k) > 0).cast("double")}
    return rows.groupBy(*keys).agg(*[made[m].alias(m) for m in BINARY])


def with_positives(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """scores of users that have positives, with is_pos and n_pos."""
    n = positives.groupBy("user_id").agg(F.count("*").alias("n_pos"))
    flagged = scores.join(positives.withColumn("is_pos", F.lit(1)), ["user_id", "item_id"], "left").join(n, "user_id")
    return flagged.withColumn("is_pos", F.coalesce("is_pos", F.lit(0)))


def check_positives(users: DataFrame, positives: DataFrame) -> None:
    """Metrics are undefined for a user without positives."""
    if n := users.select("user_id").distinct().join(positives, "user_id", "left_anti").count():
        raise ValueError(f"{n} users have no positives")


def per_user_metrics(scores: DataFrame, positives: DataFrame, *keys: str) -> DataFrame:
    """The BINARY metrics of (user_id, item_id, l1_rank, score)."""
    keys = keys or ("user_id",)
    return user_metrics(with_positives(ranked(scores, *keys), positives), *keys)


def recall_table(pool: DataFrame, cohort: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (50, 100, 200), *keys: str) -> DataFrame:
    """One row (for each of keys): recall@k and the share of users with a positive in the first k, over all cohort users."""
    pos = positives.join(cohort.select("user_id"), "user_id", "left_semi")
    if keys:
        pos = pos.crossJoin(F.broadcast(pool.select(*keys).distinct()))  # a handful of settings
    found = pos.join(pool.select(*keys, "user_id", "item_id", "rank"), [*keys, "user_id", "item_id"], "left")
    per = found.groupBy(*keys, "user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") < k).alias(f"f{k}") for k in ks])
    return per.groupBy(*keys).agg(*[x for k in ks for x in (F.avg(F.col(f"f{k}") / F.col("n")).alias(f"recall_{k}"), F.avg((F.col(f"f{k}") > 0).cast("double")).alias(f"users_with_pos_{k}"))])


def eval_cohort(pool: DataFrame, positives: DataFrame, m: int = schemas.EVAL_M) -> DataFrame:
    """(user_id) of the users whose first m candidates hold a positive."""
    return pool.where(F.col("rank") < m).join(positives, ["user_id", "item_id"], "left_semi").select("user_id").distinct()


def graded_metrics(scores: DataFrame, qrels: DataFrame, *keys: str) -> DataFrame:
    """The GRADED metrics of each query from (query_id, product_id, l1_rank, score); unjudged products count as not relevant.

    Condensed precision ranks judged products only; the ideal takes all judged products of the query.
    """
    keys = keys or ("query_id",)
    by = Window.partitionBy(*keys)
    rows = ranked(scores, *keys, item="product_id").join(qrels.select("query_id", "product_id", "label", "gain"), ["query_id", "product_id"], "left")
    rows = rows.withColumn("judged_rank", F.when(F.col("label").isNotNull(), F.count("label").over(by.orderBy("new_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1))
    best = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "product_id")) - 1)
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("r") < 10, gain_at("r", F.col("gain"))).otherwise(0.0)).alias("idcg"), F.count_if(F.col("label") == "E").alias("n_e"))
    label = F.coalesce(F.col("label"), F.lit("-"))
    n = lambda k, *labels, rank="new_rank": F.count_if(label.isin(*labels) & (F.col(rank) < k)) / k
    sums = rows.groupBy(*keys).agg(
        n(10, "E").alias("p@10"), n(5, "E").alias("p@5"), n(10, "E", "S").alias("p@10_es"), n(5, "E", "S").alias("p@5_es"),
        n(10, "E", rank="judged_rank").alias("p@10_judged"), n(5, "E", rank="judged_rank").alias("p@5_judged"),
        (F.count_if(F.col("label").isNotNull() & (F.col("new_rank") < 10)) / 10).alias("judged@10"),
        F.sum(F.when(F.col("new_rank") < 10, gain_at("new_rank", F.coalesce("gain", F.lit(0.0)))).otherwise(0.0)).alias("dcg"),
        F.count_if((label == "E") & (F.col("new_rank") < 100)).alias("got_e"),
    )
    out = sums.join(ideal, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.withColumn("ndcg@10", ratio("dcg", "idcg")).withColumn("recall@100", ratio("got_e", "n_e")).select(*keys, *[f"`{c}`" for c in GRADED])


def l1_diagnostics(pool: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """One row: recall of E (mean over queries with one), judged share (mean over rows), queries with an E in the first k."""
    rows = pool.join(qrels.select("query_id", "product_id", "label"), ["query_id", "product_id"], "left")
    per_query = rows.groupBy("query_id").agg(*[F.count_if((F.col("label") == "E") & (F.col("rank") < k)).alias(f"g{k}") for k in ks])
    n_e = qrels.groupBy("query_id").agg(F.count_if(F.col("label") == "E").alias("n_e"))
    means = n_e.join(per_query, "query_id", "left").agg(*[x for k in ks for x in (F.avg(F.coalesce(f"g{k}", F.lit(0)) / F.nullif(F.col("n_e"), F.lit(0))).alias(f"recall_e_{k}"), F.avg((F.coalesce(f"g{k}", F.lit(0)) > 0).cast("double")).alias(f"queries_with_e_{k}"))])
    judged = rows.agg(F.countDistinct("query_id").alias("queries"), *[F.avg(F.when(F.col("rank") < k, F.col("label").isNotNull().cast("double"))).alias(f"judged_{k}") for k in ks])
    return means.crossJoin(judged)  # one row each
