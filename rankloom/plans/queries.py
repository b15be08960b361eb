"""One query for each operator, over the canonical views; doubles are rounded to 6 places, scores to 9."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import hashing, text
from ..operators import channels, fusion, metrics, pools, report, scorers, stats, timeline, vectors
from ..sources import views
from ..sources.readers import keep_first
from ..storage import own_path, stored, stored_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
M, DIMS = schemas.EVAL_M, 64
#: Merged pools that channels are compared with.
COMBINATIONS = (("dense", "pop"), ("dense", "cooc"), ("cooc", "pop"), ("dense", "cooc", "pop"))


def query(f: Callable[["View"], DataFrame]) -> Callable[["View"], DataFrame]:
    """Register a query; doubles of its result are rounded, small integers widened."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return on_view(f.__name__, View(spark, sf_dir))

    QUERIES[f.__name__], _BUILT[f.__name__] = run, f
    return f


_BUILT: dict[str, Callable[["View"], DataFrame]] = {}


def on_view(name: str, view: "View") -> DataFrame:
    """The query over a view that other queries may have built tables of."""
    return tidy(_BUILT[name](view))


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        digits = 9 if name in ("l1_score", "score") else 6  # such scores are rounded to 9 places for their order already
        c = F.round(c, digits) + F.lit(0.0) if kind in ("double", "float") else c.cast("long") if kind in ("int", "smallint", "tinyint") else c
        out.append(c.alias(name))
    return df.select(*out)


class View:
    """The canonical views of a folder, and the intermediate tables that queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        for name in ("items", "item_vectors", "vectors", "search_queries", "qrels"):
            setattr(self, name, cache(lambda f=getattr(views, name): f(spark, sf_dir)))

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.dir, name)

    @cache
    def ratings(self) -> DataFrame:
        """The log, joined once: cohorts, availability, histories and counts all read it."""
        return stored(views.ratings(self.spark, self.dir))

    @cache
    def cohort(self, split: str) -> DataFrame:
        return timeline.select_cohort(self.ratings(), split)

    @cache
    def positives(self, split: str) -> DataFrame:
        return timeline.positives(self.ratings(), split)

    @cache
    def first(self) -> DataFrame:
        return timeline.first_seen(self.ratings())

    @cache
    def seen(self, split: str) -> DataFrame:
        return timeline.seen_pairs(self.ratings(), self.cohort(split))

    @cache
    def counts(self, split: str) -> DataFrame:
        return channels.popularity(self.ratings(), self.cohort(split))

    @cache
    def pop_pool(self, split: str, m: int = M) -> DataFrame:
        return stored_rows(channels.topm_shared(self.counts(split), self.cohort(split), self.first(), self.seen(split), m))

    @cache
    def cooc_pool(self, split: str, m: int = M) -> DataFrame:
        return stored_rows(channels.cooccurrence_topm(self.ratings(), self.cohort(split), m))

    @cache
    def users(self, split: str, half_lives: float | tuple[float, ...] = schemas.HALF_LIFE_DAYS) -> DataFrame:
        return stored(vectors.user_vectors(self.ratings(), self.cohort(split), self.item_vectors(), half_lives))

    @cache
    def dense_pool(self, split: str, m: int = M) -> DataFrame:
        return stored_rows(vectors.dense_topm(self.users(split), self.item_vectors(), self.first(), self.seen(split), m))

    def channel(self, name: str, split: str) -> DataFrame:
        return {"dense": self.dense_pool, "pop": self.pop_pool, "cooc": self.cooc_pool}[name](split)

    @cache
    def merged(self, split: str, names: tuple[str, ...] = ("dense", "pop")) -> DataFrame:
        return stored_rows(channels.interleave({n: self.channel(n, split) for n in names}, M))

    @cache
    def run(self, model: str, split: str = "test") -> DataFrame:
        pool = self.pop_pool(split)
        if model == "l1_order":
            return scorers.l1_order(pool)
        if model == "popularity":
            return scorers.popularity_order(pool, self.counts(split))
        if model == "oracle":
            return scorers.oracle_order(pool, self.positives(split))
        if model == "random":
            return scorers.random_order(pool)
        draw = hashing.draw(F.lit("flaky"), F.col("user_id"), F.col("item_id"))
        return scorers.popularity_order(pool, self.counts(split)).withColumn("score", F.when(draw % 50 == 0, F.lit(float("nan"))).otherwise(F.col("score")))

    def runs(self, *models: str, split: str = "test") -> DataFrame:
        return scorers.run_scores({m: self.run(m, split) for m in models})

    def eval_positives(self, split: str) -> DataFrame:
        """Positives of the users whose pool holds one."""
        pos = self.positives(split)
        return stored_rows(pos.join(metrics.eval_cohort(self.pop_pool(split), pos), "user_id", "left_semi"))

    @cache
    def knn(self, k: int = 100) -> DataFrame:
        """Each search query's nearest vectors, itself left out."""
        near = vectors.exact_topk(self.search_queries(), self.vectors(), k + 1, item="vec_id").where("query_id <> vec_id")
        return stored(near.select("query_id", F.col("vec_id").alias("product_id"), F.col("score").alias("l1_score"), (F.col("rank") - 1).alias("rank")))


def _own(v: View, name: str) -> str:
    """A place of its own in the shared folder."""
    return own_path(v.spark, name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["minimum_slice"](spark, sf_dir)


@query
def minimum_slice(v: View) -> DataFrame:
    """NDCG@10 of the popularity order for the test cohort, over users with a positive in their pool and over all."""
    n = v.cohort("test").agg(F.count("*").alias("n"))
    per = metrics.per_user_metrics(v.run("l1_order"), v.eval_positives("test"))
    sums = per.agg(F.count("*").alias("users_with_pos"), F.sum("`ndcg@10`").alias("s"))
    return n.crossJoin(sums).select(F.col("n").alias("cohort_users"), "users_with_pos", (F.col("s") / F.col("users_with_pos")).alias("ndcg_10_conditional"), (F.col("s") / F.col("n")).alias("ndcg_10_all_users"))


@query
def cohort_valid(v: View) -> DataFrame:
    return v.cohort("valid")


@query
def cohort_test(v: View) -> DataFrame:
    return v.cohort("test")


@query
def positives_test(v: View) -> DataFrame:
    return v.positives("test")


@query
def first_seen_items(v: View) -> DataFrame:
    return v.first()


@query
def popularity_90d(v: View) -> DataFrame:
    return v.counts("test")


@query
def popularity_90d_topk(v: View) -> DataFrame:
    return v.pop_pool("test")


@query
def cooccurrence_sim(v: View) -> DataFrame:
    return channels.cooccurrence(v.ratings(), v.cohort("test"))


@query
def cooccurrence_topk(v: View) -> DataFrame:
    return v.cooc_pool("test")


@query
def user_vectors(v: View) -> DataFrame:
    return v.users("test").select("user_id", "fallback", F.posexplode("v").alias("dim", "x"))


@query
def dense_topk(v: View) -> DataFrame:
    return v.dense_pool("test")


@query
def exact_knn(v: View) -> DataFrame:
    return v.knn()


@query
def judged_pools(v: View) -> DataFrame:
    items = v.vectors().select(F.col("vec_id").alias("item_id"), "v")
    return vectors.judged_lists(v.search_queries(), v.qrels(), items)


def _near_codes(v: View, k: int) -> DataFrame:
    return vectors.code_topk(v.search_queries(), v.vectors(), k, DIMS, item="vec_id")


@query
def code_candidates(v: View) -> DataFrame:
    """The candidates that compact codes choose, ranked exactly."""
    return _near_codes(v, 20)


@query
def ann_overlap(v: View) -> DataFrame:
    """How many of the exact 100 nearest the codes find, and the share of all pairs that were scored for it."""
    found = stored(_near_codes(v, M))
    near = found.where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("product_id"), (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).alias("rank"))
    pairs = v.search_queries().agg(F.count("*").alias("q")).crossJoin(v.vectors().agg(F.count("*").alias("i")))  # one row each
    share = found.agg(F.count("*").alias("n")).crossJoin(pairs).select((F.col("n") / F.col("q") / F.col("i")).alias("candidate_share"))
    return vectors.overlap_at_k(v.knn(), near, M, item="product_id").crossJoin(share)


@query
def approximate_pool(v: View) -> DataFrame:
    """The dense channel by codes: users, those left short of 100 candidates, and the candidates."""
    users = v.users("test").select("user_id", "query_time", "v")
    seen = timeline.history(v.ratings(), v.cohort("test")).select("user_id", "item_id")
    n = vectors.approximate_counts(users, v.item_vectors(), v.first(), seen, M, DIMS)
    return n.agg(F.count("*").alias("users"), F.count_if(F.col("n") < M).alias("short"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))


@query
def interleave_pool(v: View) -> DataFrame:
    return v.merged("test")


@query
def source_share(v: View) -> DataFrame:
    return channels.source_share(v.merged("test"))


@query
def leakage_audit(v: View) -> DataFrame:
    """Counts for the sound pool, and for one with planted faults."""
    pool = v.pop_pool("test")
    bad = v.seen("test").join(v.cohort("test").select("user_id", "query_time"), "user_id").select("user_id", "query_time", F.lit(7).cast("long").alias("rank"), "item_id", F.lit(0.0).alias("l1_score"))
    rows = None
    for name, p in (("sound", pool), ("planted", pool.unionByName(bad))):
        one = pools.pool_violations(p, v.ratings(), v.first()).withColumn("pool", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def profile_audit(v: View) -> DataFrame:
    return pools.profile_violations(v.ratings().join(v.cohort("test"), "user_id", "left_semi"), v.cohort("test"))


@query
def split_cut_check(v: View) -> DataFrame:
    """Cuts of a log tagged as it should be, and of one with rows of the test window in its training part."""
    valid, test = timeline.window("valid")
    tag = F.when(F.col("ts") < valid, "train").when(F.col("ts") < test, "valid").otherwise("test")
    rows = None
    for name, wrong in (("sound", F.lit(False)), ("planted", (F.col("user_id") % 50 == 0) & (F.col("ts") >= test))):
        one = timeline.split_cut_check(v.ratings().withColumn("source_split", F.when(wrong, "train").otherwise(tag))).withColumn("log", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def recall_table(v: View) -> DataFrame:
    return metrics.recall_table(v.pop_pool("test", 200), v.cohort("test"), v.positives("test"))


@query
def positive_reachability(v: View) -> DataFrame:
    return timeline.positive_reachability(v.cohort("test"), v.positives("test"), v.seen("test"), v.first())


@query
def half_life_sweep(v: View) -> DataFrame:
    users = v.users("valid", (30.0, 90.0, 180.0, 365.0))
    seen = timeline.history(v.ratings(), v.cohort("valid")).select("user_id", "item_id")
    pool = stored_rows(vectors.dense_ranks(users, v.item_vectors(), v.first(), seen, v.positives("valid"), M, "half_life"))
    return metrics.recall_table(pool, v.cohort("valid"), v.positives("valid"), (50, 100), "half_life")


@query
def channel_compare(v: View) -> DataFrame:
    """Recall of every channel and every merged pool on validation."""
    pools_ = {n: v.channel(n, "valid") for n in ("dense", "cooc", "pop")} | {"+".join(c): v.merged("valid", c) for c in COMBINATIONS}
    out = None
    for name, pool in pools_.items():
        one = pool.select(F.lit(name).alias("channel"), "user_id", "item_id", "rank")
        out = one if out is None else out.unionByName(one)
    return metrics.recall_table(stored_rows(out), v.cohort("valid"), v.positives("valid"), (50, 100), "channel")


@query
def category_screen(v: View) -> DataFrame:
    """By market segment: sizes, eligible users, unreachable share, and recall@100 of three pools on validation; the best one estimates the test users."""
    segment = v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("category"))
    r = v.ratings().join(segment, "user_id")
    sizes = r.groupBy("category").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count("*").alias("ratings"))
    eligible = v.cohort("valid").select("user_id", "query_time").join(segment, "user_id")
    pos = v.positives("valid").join(eligible, "user_id").join(v.first(), "item_id", "left")
    pools_ = {"pop": v.pop_pool("valid"), "cooc": v.cooc_pool("valid"), "cooc_pop": v.merged("valid", ("cooc", "pop"))}
    for name, pool in pools_.items():
        pos = pos.join(pool.select("user_id", "item_id", F.col("rank").alias(name)), ["user_id", "item_id"], "left")
    per = pos.groupBy("category", "user_id").agg(F.count("*").alias("n"), *[F.count(name).alias(name) for name in pools_], F.count_if(~F.coalesce(F.col("first_seen") < F.col("query_time"), F.lit(False))).alias("new"))
    shares = [x for name in pools_ for x in (F.avg(F.col(name) / F.col("n")).alias(f"{name}_recall_100"), F.avg((F.col(name) > 0).cast("double")).alias(f"{name}_users_with_pos_100"))]
    means = per.groupBy("category").agg(F.count("*").alias("eligible_valid_users"), F.avg("n").alias("positives_per_user"), (F.sum("new") / F.sum("n")).alias("unreachable_share"), *shares)
    test = v.cohort("test").join(segment, "user_id").groupBy("category").agg(F.count("*").alias("eligible_test_users"))
    best = F.greatest(*[F.col(f"{name}_users_with_pos_100") for name in pools_])
    return sizes.join(means, "category").join(test, "category").withColumn("est_test_eval_users", F.floor(best * F.col("eligible_test_users") + 1e-9))


@query
def eval_cohort(v: View) -> DataFrame:
    return metrics.eval_cohort(v.pop_pool("test"), v.positives("test"))


def _score_query(model: str) -> None:
    def f(v: View) -> DataFrame:
        per = metrics.per_user_metrics(v.run(model), v.eval_positives("test"))
        return per.select("user_id", *[F.col(f"`{m}`").alias(m.replace("@", "_")) for m in metrics.BINARY])

    f.__name__ = f"score_{model}"
    query(f)


for _model in ("l1_order", "popularity", "oracle", "random"):
    _score_query(_model)


@query
def failed_scores_rank_last(v: View) -> DataFrame:
    """The flaky run's order, in which NaN comes last."""
    return metrics.ranked(v.run("flaky")).select("user_id", "item_id", "l1_rank", "new_rank")


@query
def contract_audit(v: View) -> DataFrame:
    return scorers.contract_violations(v.run("flaky"), v.pop_pool("test"))


def _graded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(f"`{m}`").alias(m.replace("@", "_")) for m in metrics.GRADED])


@query
def graded_metrics(v: View) -> DataFrame:
    scores = v.knn().select("query_id", "product_id", F.col("rank").alias("l1_rank"), (-F.col("rank")).cast("double").alias("score"))
    return _graded(metrics.graded_metrics(scores, v.qrels()), "query_id")


@query
def graded_oracle(v: View) -> DataFrame:
    return _graded(metrics.graded_metrics(scorers.graded_oracle(v.knn(), v.qrels()), v.qrels()), "query_id")


@query
def l1_diagnostics(v: View) -> DataFrame:
    return metrics.l1_diagnostics(v.knn(), v.qrels())


@query
def rrf_fusion(v: View) -> DataFrame:
    return fusion.fuse_scores(v.run("random"), v.run("popularity"), 0.3)


@query
def rrf_tuning(v: View) -> DataFrame:
    return fusion.tune(v.run("random"), v.run("popularity"), v.eval_positives("test"))


@query
def channel_diagnostics(v: View) -> DataFrame:
    pool = v.merged("test").withColumnRenamed("rank", "l1_rank")
    scores = scorers.run_scores({"l1_order": scorers.l1_order(v.merged("test")), "random": scorers.random_order(v.merged("test"))})
    return report.diagnose(pool, v.positives("test"), scores)


def _eval_per_user(v: View, *models: str) -> DataFrame:
    return stored_rows(scorers.evaluate(v.runs(*models), v.eval_positives("test")))


@query
def paired_bootstrap(v: View) -> DataFrame:
    return stats.paired_bootstrap(report.differences(_eval_per_user(v, "l1_order", "random"), "ndcg@10"))


@query
def holm_table(v: View) -> DataFrame:
    per = _eval_per_user(v, "l1_order", "popularity", "random", "flaky")
    return stats.compare_to_baseline(report.differences(per, "ndcg@10"))


@query
def leaderboard(v: View) -> DataFrame:
    per = _eval_per_user(v, "l1_order", "popularity", "random", "flaky", "oracle")
    board = report.leaderboard(per, v.cohort("test").agg(F.count("*").alias("n")))
    return board.toDF(*[c.replace("@", "_") for c in board.columns])


@query
def leaderboard_graded(v: View) -> DataFrame:
    pool = v.knn()
    keep = pool.select("query_id", "product_id", F.col("rank").alias("l1_rank"))
    runs = {
        "l1_order": keep.withColumn("score", -F.col("l1_rank").cast("double")),
        "random": keep.withColumn("score", hashing.draw(F.lit(0), F.col("query_id"), F.col("product_id")) / F.lit(4294967296.0)),
        "oracle": scorers.graded_oracle(pool, v.qrels()),
    }
    every = None
    for name, df in runs.items():
        one = df.withColumn("model", F.lit(name))
        every = one if every is None else every.unionByName(one)
    board = report.graded_leaderboard(stored(metrics.graded_metrics(every, v.qrels(), "model", "query_id")))
    return board.toDF(*[c.replace("@", "_") for c in board.columns])


@query
def rating5_sensitivity(v: View) -> DataFrame:
    """Recall of the popularity pool against top-rated positives only."""
    pos = timeline.positives(v.ratings(), "test", 5)
    return metrics.recall_table(v.pop_pool("test", 200), v.cohort("test").join(pos, "user_id", "left_semi"), pos)


@query
def clean_html(v: View) -> DataFrame:
    return v.table("pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query
def product_text(v: View) -> DataFrame:
    """Pages as products: the title from the URL, the brand from the host, bullets of two lines, the page as description."""
    rows = v.table("pages").select("page_id", F.col("url").alias("product_title"), F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("<b>b&amp;"), F.col("page_id"), F.lit("</b>"))).alias("product_brand"), F.when(F.col("page_id") % 2 > 0, F.lit("  ")).alias("product_color"), F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("one &copy; <i>x</i>\n\n two  "), F.col("page_id"))).alias("product_bullet_point"), F.col("html").alias("product_description"))
    return rows.select("page_id", text.product_text().alias("text"))


@query
def token_cut(v: View) -> DataFrame:
    return v.table("documents").select("doc_id", text.cut(F.col("text"), schemas.ITEM_TOKENS).alias("c")).select("doc_id", "c.text", "c.truncated", "c.n_tokens")


@query
def render_item(v: View) -> DataFrame:
    i = v.items()
    fields = {"title": F.col("title"), "store": F.col("store"), "categories": F.array_join("categories", "; "), "price": F.when(F.col("item_id") % 4 > 0, F.floor("price").cast("string"))}
    return i.select("item_id", text.cut(text.render_item(fields), 8).alias("c"), F.array_join(text.item_attrs(F.col("categories"), F.col("store")), "|").alias("attrs")).select("item_id", "c.text", "c.truncated", "c.n_tokens", "attrs")


@query
def render_profile(v: View) -> DataFrame:
    items = v.items().select("item_id", "title", text.item_attrs(F.col("categories"), F.col("store")).alias("attrs"))
    return text.build_profiles(timeline.history(v.ratings(), v.cohort("test")), items, 60)


@query
def dedup_keep_first(v: View) -> DataFrame:
    rows = v.ratings().select("user_id", "item_id", "ts", "rating", "l_orderkey", "l_linenumber")
    return keep_first(rows, ["user_id", "item_id", "ts"], ["l_orderkey", "l_linenumber"]).select("user_id", "item_id", "ts", "rating", "l_orderkey", "l_linenumber")


@query
def md5_sample(v: View) -> DataFrame:
    return hashing.sample(v.cohort("test"), "user_id", 50)


@query
def label_stats(v: View) -> DataFrame:
    n = v.qrels().groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "E").alias("e"))
    shares = v.qrels().agg(*[(F.count_if(F.col("label") == s) / F.count("*")).alias(f"share_{s.lower()}") for s in "ESCI"])
    return n.agg(F.percentile("n", F.lit(0.5)).alias("judged_median"), F.avg("e").alias("exact_mean"), F.count("*").alias("queries")).crossJoin(shares)


@query
def length_stats(v: View) -> DataFrame:
    n = F.size(text.tokens(F.col("text")))
    d = v.table("documents").select(n.alias("n"))
    return d.agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), *[F.percentile("n", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.95)], F.max("n").alias("max"), F.count_if(F.col("n") == 0).alias("empty"))


@query
def hash_embedding(v: View) -> DataFrame:
    return hashing.hash_embedding(v.items(), "item_id", "title").select("item_id", F.posexplode("v").alias("dim", "x"))


@query
def freeze_digest(v: View) -> DataFrame:
    """The digest that freezing the pool writes beside it, and the rows it covers."""
    at = _own(v, "pool")
    digest = pools.freeze(v.pop_pool("test"), at)
    rows, again = pools.load_frozen(v.spark, at)
    return rows.agg(F.lit(digest).alias("digest"), F.lit(again).alias("digest_read"), F.count("*").alias("rows"))


@query
def cost_latency(v: View) -> DataFrame:
    """Events as calls of a model: latency quantiles, failures and cost."""
    e = v.table("events").select(F.col("event_type").alias("model"), (F.col("value") / 1000).alias("latency_s"), F.length("props").cast("long").alias("tokens"), (F.col("event_id") % 97 == 0).alias("failed"))
    return e.groupBy("model").agg(F.percentile("latency_s", F.lit(0.5)).alias("latency_p50"), F.percentile("latency_s", F.lit(0.95)).alias("latency_p95"), F.count_if("failed").alias("failures"), text.cost(F.sum("tokens"), 0.24).alias("cost_usd"))


@query
def latest_run(v: View) -> DataFrame:
    """Events as runs: the latest of each model, limited ones left out."""
    e = v.table("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("run_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("started_at"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2).alias("limit_users"))
    return report.latest_runs(e).select("model", "run_id", "started_at")


@query
def preparation_report(v: View) -> DataFrame:
    fields = {"title": F.col("title"), "store": F.col("store"), "categories": F.array_join("categories", "; ")}
    items = v.items().select("item_id", text.cut(text.render_item(fields), 9).getField("truncated").alias("truncated"))
    named = v.items().select("item_id", "title", text.item_attrs(F.col("categories"), F.col("store")).alias("attrs"))
    profiles = text.build_profiles(timeline.history(v.ratings(), v.cohort("test")), named, 60)
    return report.preparation(items, profiles, v.cohort("test"), v.ratings())


@query
def pool_sizes(v: View) -> DataFrame:
    """How many candidates users have in the co-occurrence pool."""
    n = v.cooc_pool("test").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), *[F.percentile("n", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max("n").alias("max"))


@query
def run_totals(v: View) -> DataFrame:
    """Events as calls: failures, retries and versions of each model."""
    e = v.table("events").select(F.col("event_type").alias("model"), (F.col("event_id") % 97 == 0).cast("int").alias("failures"), (F.col("event_id") % 5).alias("retries"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("version"))
    return scorers.run_totals(e)


@query
def error_histogram(v: View) -> DataFrame:
    e = v.table("events").where("event_id % 97 = 0").select(F.concat(F.lit("error "), F.col("event_id") % 4).alias("error"))
    return scorers.error_histogram(e)


@query
def markdown_rows(v: View) -> DataFrame:
    """The graded leaderboard's means as Markdown cells."""
    board = on_view("leaderboard_graded", v)
    return board.select("model", text.plain(F.col("p_10")).alias("p_10"), text.signed(F.col("diff_vs_l1")).alias("diff"))


@query
def robustness_rule(v: View) -> DataFrame:
    """Do the differences of NDCG@10 have one sign whether positives are liked items or top-rated ones?"""
    models = ("l1_order", "popularity", "random", "flaky")
    diffs = lambda pos: report.differences(scorers.evaluate(v.runs(*models), pos), "ndcg@10").groupBy("model").agg(F.avg("diff").alias("diff_vs_l1"))
    top = timeline.positives(v.ratings(), "test", 5)
    reached = metrics.eval_cohort(v.pop_pool("test"), top)
    rounded = lambda df: df.withColumn("diff_vs_l1", F.round("diff_vs_l1", 9))
    return report.robustness(rounded(diffs(v.eval_positives("test"))), rounded(diffs(top.join(reached, "user_id", "left_semi"))))
