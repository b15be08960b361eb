"""Time-correct cohorts, outcomes and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.hashing import draw


def to_ts(c: Column, kind: str) -> Column:
    """Unix milliseconds become UTC timestamps; a time without zone is taken as UTC (the session's zone); others stay."""
    if kind in ("bigint", "int"):
        return F.timestamp_millis(c)
    return c.cast("timestamp") if kind == "timestamp_ntz" else c


def window(split: str) -> tuple[Column, Column | None]:
    """Start and end of a split's outcome window, the end open or none; other names raise."""
    cuts = {"valid": (schemas.VALID_START, schemas.TEST_START), "test": (schemas.TEST_START, None)}
    if split not in cuts:
        raise ValueError(f"unknown split: {split}")
    start, end = cuts[split]
    lit = lambda t: F.expr(f"timestamp_ntz'{t}'")
    return lit(start), lit(end) if end else None


def in_window(split: str, ts: str = "ts") -> Column:
    start, end = window(split)
    inside = F.col(ts) >= start
    return inside if end is None else inside & (F.col(ts) < end)


def select_cohort(ratings: DataFrame, split: str, min_prior: int = schemas.MIN_PRIOR, min_pos: int = schemas.MIN_POS, like: float = schemas.LIKE, n_users: int | None = None, seed: int = 0) -> DataFrame:
    """(user_id, query_time, n_prior, n_pos): users with enough events before the window and positive ones in it.

    Both count rows, not items. A sample of n_users takes the smallest draws of (seed, user).
    """
    start, _ = window(split)
    counted = ratings.groupBy("user_id").agg(F.count_if(F.col("ts") < start).alias("n_prior"), F.count_if(in_window(split) & (F.col("rating") >= like)).alias("n_pos"))
    cohort = counted.where((F.col("n_prior") >= min_prior) & (F.col("n_pos") >= min_pos)).select("user_id", start.alias("query_time"), "n_prior", "n_pos")
    if n_users is not None:
        cohort = cohort.orderBy(draw(F.lit(seed), F.col("user_id")), "user_id").limit(n_users)
    return cohort


def positives(ratings: DataFrame, split: str, like: float = schemas.LIKE) -> DataFrame:
    """Distinct (user_id, item_id) liked within the window, of all users."""
    return ratings.where(in_window(split) & (F.col("rating") >= like)).select("user_id", "item_id").distinct()


def first_seen(ratings: DataFrame) -> DataFrame:
    """(item_id, first_seen): the first event anywhere in the log stands for availability."""
    return ratings.groupBy("item_id").agg(F.min("ts").alias("first_seen"))


def history(ratings: DataFrame, cohort: DataFrame) -> DataFrame:
    """Each cohort user's events strictly before the own query time."""
    return ratings.join(cohort.select("user_id", "query_time"), "user_id").where("ts < query_time")


def seen_pairs(ratings: DataFrame, cohort: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id) of the histories."""
    return history(ratings, cohort).select("user_id", "item_id").distinct()


def liked_or_all(rows: DataFrame, like: float = schemas.LIKE) -> DataFrame:
    """A user's liked rows, or all of a user without one, with `fallback` telling which.

    The flag is an aggregate joined back, so no window has to hold a user's rows.
    """
    flag = rows.groupBy("user_id").agg((F.max("rating") < like).alias("fallback"))
    return rows.join(flag, "user_id").where((F.col("rating") >= like) | F.col("fallback"))


def split_cut_check(ratings: DataFrame, tagged: str = "source_split") -> DataFrame:
    """One row: the extreme times of each split and whether they respect the cuts."""
    wide = ratings.groupBy().agg(*[f(F.when(F.col(tagged) == s, F.col("ts"))).alias(f"{s}_{n}") for s in ("train", "valid", "test") for n, f in (("first", F.min), ("last", F.max))])
    valid, test = window("valid")
    return wide.withColumn("ok", (F.col("train_last") < valid) & (valid <= F.col("valid_first")) & (F.col("valid_last") < test) & (test <= F.col("test_first")))


def positive_reachability(cohort: DataFrame, pos: DataFrame, seen: DataFrame, first: DataFrame) -> DataFrame:
    """One row: users, positives, and the shares of positives not yet available, already seen, and reachable at most."""
    rows = pos.join(cohort.select("user_id", "query_time"), "user_id").join(first, "item_id", "left").join(seen.withColumn("again", F.lit(1)), ["user_id", "item_id"], "left")
    new = F.count_if(~F.coalesce(F.col("first_seen") < F.col("query_time"), F.lit(False)))
    again, n = F.count_if(F.col("again") == 1), F.count("*")
    return rows.agg(F.countDistinct("user_id").alias("n_users"), n.alias("n_positives"), (new / n).alias("share_not_yet_available"), (again / n).alias("share_already_seen"), (1 - (new + again) / n).alias("max_reachable_share"))
