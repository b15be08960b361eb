"""Run selection, leaderboards, channel diagnostics and the category screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import plain, signed
from .metrics import BINARY, GRADED, ranked
from .stats import compare_to_baseline


def latest_runs(manifests: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """The latest run of each model, of equal starts the last run_id; runs limited to a few users are left out."""
    whole = manifests.where(F.coalesce("limit_users", F.lit(0)) == 0) if "limit_users" in manifests.columns else manifests
    if without:
        whole = whole.where(~F.col("model").isin(*without))
    rest = [c for c in whole.columns if c != "model"]
    return whole.groupBy("model").agg(F.max_by(F.struct(*rest), F.struct("started_at", "run_id")).alias("r")).select("model", "r.*")


def select_runs(manifests: DataFrame, split: str, cohort: str | None = None, setting: str | None = None, top_m: int | None = None) -> DataFrame:
    """Runs of a split and, where given, of a cohort (none named: 'all'), a setting, a list length."""
    out = manifests.where(F.col("split") == split)
    if cohort is not None:
        out = out.where(F.coalesce("eval_cohort", F.lit("all")) == cohort)
    if setting is not None:
        out = out.where(F.col("setting") == setting)
    return out if top_m is None else out.where(F.col("top_m") == top_m)


def check_one_hash(manifests: DataFrame, *columns: str) -> None:
    """All runs must be of one pool (and cohort); an absent hash counts as a value."""
    for c in columns:
        if (n := manifests.select(c).distinct().count()) != 1:
            raise ValueError(f"runs have {n} different values of {c}")


def check_aligned(per_user: DataFrame, base: str = "l1_order") -> None:
    """Every model must cover the baseline's users; its other users are dropped later."""
    users = per_user.where(F.col("model") == base).select("user_id")
    if not users.head(1):
        raise ValueError(f"without a run of {base} there is nothing to compare with")
    want = per_user.select("model").distinct().crossJoin(users)  # models are few
    if n := want.join(per_user.select("model", "user_id"), ["model", "user_id"], "left_anti").count():
        raise ValueError(f"{n} users are missing from some run")


def differences(per_user: DataFrame, metric: str, base: str = "l1_order") -> DataFrame:
    """(model, user_id, diff) of the tested models against the baseline's users."""
    own = per_user.select("model", "user_id", F.col(f"`{metric}`").alias("x"))
    ref = own.where(F.col("model") == base).select("user_id", F.col("x").alias("y"))
    return own.where(~F.col("model").isin(*schemas.NOT_TESTED)).join(ref, "user_id").select("model", "user_id", (F.col("x") - F.col("y")).alias("diff"))


def leaderboard(per_user: DataFrame, n_full: DataFrame | None = None, primary: str = "ndcg@10", metrics: tuple[str, ...] = BINARY, n_resamples: int = schemas.N_RESAMPLES, seed: int = 0) -> DataFrame:
    """A row for each model: means, all-user mean of the primary metric, latency quantiles if known, and tests against l1_order.

    n_full is one row with the full cohort's size (`n`): users outside a conditional cohort score 0.
    """
    users = per_user.where(F.col("model") == "l1_order").select("user_id")
    rows = per_user.join(users, "user_id", "left_semi")
    latency = [F.percentile("latency_s", F.lit(q)).alias(f"latency_p{int(q * 100)}_s") for q in (0.5, 0.95)] if "latency_s" in rows.columns else []
    means = rows.groupBy("model").agg(*[F.avg(f"`{m}`").alias(m) for m in metrics], *latency, F.sum(f"`{primary}`").alias("_sum"))
    if n_full is not None:
        means = means.crossJoin(n_full).withColumn(f"{primary}_all_users", F.col("_sum") / F.col("n")).drop("n")
    tests = compare_to_baseline(differences(rows, primary), n_resamples, seed)
    tests = tests.select("model", F.col("mean_diff").alias("diff_vs_l1"), "ci_low", "ci_high", "p_holm", F.col("significant").alias("beats_l1"))
    return means.drop("_sum").join(tests, "model", "left")


def markdown(board: DataFrame, primary: str = "ndcg@10") -> DataFrame:
    """(place, line) of the leaderboard as Markdown rows, best first."""
    cell = F.when(F.col("diff_vs_l1").isNotNull(), F.concat(signed(F.col("diff_vs_l1")), F.lit(" ["), signed(F.col("ci_low")), F.lit(", "), signed(F.col("ci_high")), F.lit("]"))).otherwise("—")
    beats: Column = F.when(F.col("beats_l1").isNull(), "—").when(F.col("beats_l1"), "yes").otherwise("no")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "model", plain(F.col(f"`{primary}`")), cell, plain(F.col("p_holm")), beats), F.lit(" |"))
    return board.select(F.row_number().over(Window.orderBy(F.desc(f"`{primary}`"), "model")).alias("place"), line.alias("line"))


def graded_leaderboard(per_query: DataFrame, n_resamples: int = schemas.N_RESAMPLES, seed: int = 0) -> DataFrame:
    """The leaderboard of graded runs on p@10; per_query has model, query_id and the GRADED metrics."""
    return leaderboard(per_query.withColumnRenamed("query_id", "user_id"), None, "p@10", GRADED, n_resamples, seed)


def cost_per_thousand(cost_usd: Column, queries: Column) -> Column:
    """What a thousand queries cost; null if the cost is not known or nothing was asked."""
    return 1000 * cost_usd / F.nullif(queries, F.lit(0))


def positives_by_channel(pool: DataFrame, positives: DataFrame, m: int = schemas.EVAL_M) -> DataFrame:
    """(source, positives, share): which channel the positives among the first m candidates came from."""
    n = pool.where(F.col("rank") < m).join(positives, ["user_id", "item_id"], "left_semi").groupBy("source").agg(F.count("*").alias("positives"))
    return n.crossJoin(n.agg(F.sum("positives").alias("all"))).select("source", "positives", (F.col("positives") / F.col("all")).alias("share"))  # one row


def diagnose(pool: DataFrame, positives: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """(model, source, topk_share, pos_mean_rank, pos_in_topk): where each model takes its first k from, by channel.

    source 'all' has the mean rank of all positives. Means over no rows are null.
    """
    rows = ranked(scores, "model", "user_id").join(pool.select("user_id", "item_id", "source"), ["user_id", "item_id"], "left").join(positives.withColumn("pos", F.lit(1)), ["user_id", "item_id"], "left")
    top, pos = F.col("new_rank") < k, F.col("pos") == 1
    by = rows.groupBy("model", "source").agg(F.count_if(top).alias("n_top"), F.avg(F.when(pos, F.col("new_rank"))).alias("pos_mean_rank"), F.avg(F.when(pos, top.cast("double"))).alias("pos_in_topk"))
    total = rows.groupBy("model").agg(F.count_if(top).alias("all_top"), F.avg(F.when(pos, F.col("new_rank"))).alias("pos_mean_rank"))
    each = by.join(total.select("model", "all_top"), "model").where("source is not null").select("model", "source", (F.col("n_top") / F.col("all_top")).alias("topk_share"), "pos_mean_rank", "pos_in_topk")
    return each.unionByName(total.select("model", F.lit("all").alias("source"), F.lit(None).cast("double").alias("topk_share"), "pos_mean_rank", F.lit(None).cast("double").alias("pos_in_topk")))


def robustness(a: DataFrame, b: DataFrame) -> DataFrame:
    """(model, robust): do both leaderboards' differences have one sign?"""
    both = a.select("model", F.col("diff_vs_l1").alias("x")).join(b.select("model", F.col("diff_vs_l1").alias("y")), "model")
    return both.select("model", (F.signum("x") == F.signum("y")).alias("robust"))


def preparation(items: DataFrame, profiles: DataFrame, cohort: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: items, those wanted but without metadata, shares cut to the budget, users, mean positives."""
    i = items.agg(F.count("*").alias("items"), F.avg(F.col("truncated").cast("double")).alias("item_truncated_share"))
    gap = wanted.select("item_id").distinct().join(items, "item_id", "left_anti").agg(F.count("*").alias("items_without_metadata"))
    p = profiles.agg(F.avg(F.col("profile_truncated").cast("double")).alias("profile_truncated_share"))
    c = cohort.agg(F.count("*").alias("users"), F.avg("n_pos").alias("positives_per_user"))
    return i.crossJoin(gap).crossJoin(p).crossJoin(c)  # one row each
