"""Weighted reciprocal rank fusion and its tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .metrics import per_user_metrics, ranked


def check_cover(a: DataFrame, b: DataFrame) -> None:
    """Both runs must score the same (user, item) pairs."""
    pair = ["user_id", "item_id"]
    if n := a.select(pair).exceptAll(b.select(pair)).unionAll(b.select(pair).exceptAll(a.select(pair))).count():
        raise ValueError(f"{n} candidates are in one of the two runs only")


def both_ranks(reranker: DataFrame, partner: DataFrame) -> DataFrame:
    """(user_id, item_id, l1_rank, r, p): ranks from 1 in either run."""
    r = ranked(reranker).select("user_id", "item_id", "l1_rank", (F.col("new_rank") + 1).alias("r"))
    p = ranked(partner).select("user_id", "item_id", (F.col("new_rank") + 1).alias("p"))
    return r.join(p, ["user_id", "item_id"])


def rrf(w: float | Column, k: int = schemas.RRF_K) -> Column:
    w = w if isinstance(w, Column) else F.lit(float(w))
    return w / (F.lit(k) + F.col("r")) + (F.lit(1.0) - w) / (F.lit(k) + F.col("p"))


def fuse_scores(reranker: DataFrame, partner: DataFrame, w: float, k: int = schemas.RRF_K) -> DataFrame:
    """(user_id, item_id, l1_rank, score): w for the reranker, 1 - w for the partner."""
    return both_ranks(reranker, partner).select("user_id", "item_id", "l1_rank", rrf(w, k).alias("score"))


def tune(reranker: DataFrame, partner: DataFrame, positives: DataFrame, grid: tuple[float, ...] = schemas.GRID, k: int = schemas.RRF_K) -> DataFrame:
    """(w, ndcg_10, chosen): the mean NDCG@10 of every weight of the grid, in one job.

    The best mean, after rounding to 12 places, is chosen; of equal ones the smaller weight.
    """
    every = both_ranks(reranker, partner).withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in grid])))
    scored = every.select("w", "user_id", "item_id", "l1_rank", rrf(F.col("w"), k).alias("score"))
    means = per_user_metrics(scored, positives, "w", "user_id").groupBy("w").agg(F.avg("`ndcg@10`").alias("ndcg_10"))
    best = means.agg(F.min_by("w", F.struct(-F.round("ndcg_10", 12), "w")).alias("best"))
    return means.crossJoin(best).select("w", "ndcg_10", (F.col("w") == F.col("best")).alias("chosen"))


def fuse_run(valid: tuple[DataFrame, DataFrame], test: tuple[DataFrame, DataFrame], valid_positives: DataFrame, test_positives: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """Tune on validation, apply once on test: (weight, fused scores, metrics of each user)."""
    for a, b in (valid, test):
        check_cover(a, b)
    w = tune(*valid, valid_positives).where("chosen").first()["w"]
    fused = fuse_scores(*test, w)
    return w, fused, per_user_metrics(fused, test_positives)
