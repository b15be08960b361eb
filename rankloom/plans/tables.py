"""Queries that go through files: what is written is read back; and guards, prompts and scorers, each with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fusion, metrics, pools, report, scorers, timeline
from ..sources import readers, sinks
from ..storage import own_path, stored
from .oracle import ORACLE_SQL, PARTS, draw, r6, statement
from .queries import View, query


def _at(v: View, name: str) -> str:
    return own_path(v.spark, name)


def _sql(name: str, select: str, parts: dict[str, str] | None = None) -> None:
    ORACLE_SQL[name] = statement(select, parts)


@query
def ratings_log(v: View) -> DataFrame:
    """The log written as three CSV files in order, some lines twice, and read again."""
    at = _at(v, "raw")
    valid, test = timeline.window("valid")
    r = v.ratings().withColumn("k", F.when(F.col("ts") < valid, 0).when(F.col("ts") < test, 1).otherwise(2))
    lines = r.select("k", F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("parent_asin"), F.col("rating").cast("double").alias("rating"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("a b").alias("history"), "l_orderkey", "l_linenumber")
    lines = stored(lines.withColumn("copy", F.explode(F.when(F.col("l_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))))
    for k, split in enumerate(("train", "valid", "test")):
        lines.where(F.col("k") == k).repartition(1).sortWithinPartitions("l_orderkey", "l_linenumber", "rating", "copy").select("user_id", "parent_asin", "rating", "timestamp", "history").write.csv(f"{at}/C.{split}.csv.gz", header=True, compression="gzip")
    return readers.load_ratings(v.spark, at, "C")


_sql("ratings_log", "select user_id::varchar as user_id, item_id::varchar as parent_asin, rating::double as rating, epoch_ms(ts) as timestamp, case when ts < v then 'train' when ts < t then 'valid' else 'test' end as source_split from ratings, cuts qualify row_number() over (partition by user_id, item_id, ts order by l_orderkey, l_linenumber, rating) = 1")


@query
def rating_times(v: View) -> DataFrame:
    """Times as Unix milliseconds and back, and whose outcome window they are in."""
    ms = v.ratings().select("user_id", "item_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    rows = ms.withColumn("ts", timeline.to_ts(F.col("ms"), "bigint").cast("timestamp_ntz"))
    return rows.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(timeline.in_window("valid")).alias("valid"), F.count_if(timeline.in_window("test")).alias("test"))


_sql("rating_times", "select strftime(ts, '%Y-%m') as month, count(*) as n, count(*) filter (ts >= v and ts < t) as valid, count(*) filter (ts >= t) as test from ratings, cuts group by 1")


@query
def item_metadata(v: View) -> DataFrame:
    """Items as JSON lines, with columns of the future and every third one twice; read for the rated items."""
    at = _at(v, "raw")
    rows = v.items().select(F.col("item_id").cast("string").alias("parent_asin"), "title", "categories", "store", F.col("size").alias("average_rating"), F.explode(F.when(F.col("item_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    rows.withColumn("title", F.when(F.col("copy") == 1, "again").otherwise(F.col("title"))).repartitionByRange(1, "copy").sortWithinPartitions("copy", "parent_asin").drop("copy").write.json(f"{at}/meta_C.jsonl.gz", compression="gzip")
    found = readers.load_meta(v.spark, at, v.ratings().select(F.col("item_id").cast("string").alias("parent_asin")), "C")
    return found.select("parent_asin", "title", F.array_join("categories", "|").alias("categories"), "store", F.lit(len(pools.check_item_fields(found))).alias("forbidden"))


_sql("item_metadata", "select p_partkey::varchar as parent_asin, p_name as title, p_type as categories, p_brand as store, 0::bigint as forbidden from part semi join ratings on item_id = p_partkey")


@query
def search_examples(v: View) -> DataFrame:
    """Judged pairs in two sizes and two locales, queries padded with blanks."""
    at = _at(v, "examples")
    rows = v.qrels().select("query_id", F.concat(F.lit("\u00a0 query "), F.col("query_id"), F.lit(" \t")).alias("query"), F.col("product_id").cast("string").alias("product_id"), F.when(F.col("product_id") % 5 == 0, "es").otherwise("us").alias("product_locale"), F.col("label").alias("esci_label"), (F.col("product_id") % 2).cast("int").alias("small_version"), F.lit("test").alias("split"))
    rows.write.parquet(at)
    return readers.load_examples(v.spark, at)


_sql("search_examples", "select query_id, 'query ' || query_id as query, product_id::varchar as product_id, 'us' as product_locale, label as esci_label, 'test' as split from qrels where product_id % 2 = 1 and product_id % 5 <> 0")


def _products(v: View) -> str:
    """Pages as products in one sorted file: three pages share an id, every seventh page is of another locale."""
    at = _at(v, "products")
    rows = v.table("pages").select((F.col("page_id") % 101).cast("string").alias("product_id"), F.col("url").alias("product_title"), F.col("html").alias("product_description"), F.lit("one &eacute;\n\ntwo").alias("product_bullet_point"), F.lit(None).cast("string").alias("product_brand"), F.lit(" ").alias("product_color"), F.when(F.col("page_id") % 7 == 0, "jp").otherwise("us").alias("product_locale"), "page_id")
    rows.repartitionByRange(1, "page_id").sortWithinPartitions("page_id").drop("page_id").write.parquet(at)
    return at


@query
def search_products(v: View) -> DataFrame:
    """The first row of each id, of those that are asked for."""
    ids = v.table("pages").select((F.col("page_id") % 101).cast("string").alias("product_id")).where("cast(product_id as int) % 2 = 0")
    return readers.load_products(v.spark, _products(v), "us", ids).select("product_id", "product_title", "product_locale")


_FIRST_PAGE = "select * from pages where page_id % 7 <> 0 qualify row_number() over (partition by page_id % 101 order by page_id) = 1"
_sql("search_products", f"select (page_id % 101)::varchar as product_id, url as product_title, 'us' as product_locale from ({_FIRST_PAGE}) p where page_id % 101 % 2 = 0")


@query
def product_store(v: View) -> DataFrame:
    """Products written as (id, text): what is in the file, and what the writer tells of it."""
    at = _at(v, "store")
    told = sinks.write_products(v.spark, _products(v), at)
    rows = v.spark.read.parquet(at).select("product_id", F.length("text").alias("chars"))
    return rows.crossJoin(told.select(F.col("count").alias("n"), "text_chars_median", "text_chars_p95", "empty_text"))  # one row


def _clean_sql(c: str) -> str:
    from .oracle import clean

    return clean(c)


_sql(
    "product_store",
    "select product_id, chars, (select count(*) from texts) as n, (select round(quantile_cont(chars, 0.5), 6) + 0.0 from sampled) as text_chars_median, (select round(quantile_cont(chars, 0.95), 6) + 0.0 from sampled) as text_chars_p95, (select count(*) from texts where chars = 0) as empty_text from texts",
    {
        "sampled": f"select chars from texts where {draw(chr(39) + 'length' + chr(39), 'product_id')} % 10 = 0",
        "texts": f"select (page_id % 101)::varchar as product_id, length(array_to_string(list_filter([nullif({_clean_sql('url')}, ''), 'Features: one é; two', 'Description: ' || nullif({_clean_sql('html')}, '')], lambda x: x is not null), chr(10))) as chars from ({_FIRST_PAGE}) p",
    },
)


@query
def frozen_pool(v: View) -> DataFrame:
    """The first ten of a frozen pool, read with its digest checked."""
    at = _at(v, "pool")
    pools.freeze(v.pop_pool("test"), at)
    return pools.load_frozen(v.spark, at, 10)[0].select("user_id", "query_time", "rank", "item_id", "l1_score")


_sql("frozen_pool", "select user_id, query_time, rank, item_id, l1_score from pool where rank < 10")


@query
def frozen_pair(v: View) -> DataFrame:
    """Both kinds of a search's lists, frozen side by side."""
    from ..operators import vectors

    at = _at(v, "search")
    judged = vectors.judged_lists(v.search_queries(), v.qrels(), v.vectors().select(F.col("vec_id").alias("item_id"), "v"))
    pools.freeze_pair(v.knn().select("query_id", "product_id", "rank", F.col("l1_score").alias("score")), judged, at)
    out = None
    for kind in ("retrieved", "judged"):
        one = pools.load_frozen(v.spark, f"{at}/{kind}", group="query_id")[0].groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("product_id", -F.col("rank")).alias("first")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


_sql("frozen_pair", "select query_id, 'retrieved' as kind, count(*) as n, arg_min(product_id, rank) as first from knn group by 1 union all select query_id, 'judged', count(*), arg_max(product_id, (s, -product_id)) from (select query_id, product_id, round(list_dot_product(q.v, x.v), 9) as s from qrels join (select query_id, v from queries) q using (query_id) join vecs x on vec_id = product_id) j group by 1")


@query
def split_tables(v: View) -> DataFrame:
    """Cohort and positives as a prepared split has them."""
    at = _at(v, "processed")
    sinks.write_split(at, "test", v.cohort("test"), v.positives("test"), timeline.positives(v.ratings(), "test", 5))
    cohort, pos = readers.load_split(v.spark, at, "test")
    return pos.join(cohort, "user_id").select("user_id", "item_id", "is_rating5", "n_prior", "query_time")


_sql("split_tables", "select p.user_id, p.item_id, (f.item_id is not null)::bigint as is_rating5, n_prior, query_time from positives_test p join cohort_test using (user_id) left join (select distinct user_id, item_id from ratings, cuts where ts >= t and rating >= 5) f on f.user_id = p.user_id and f.item_id = p.item_id")


@query
def run_folder(v: View) -> DataFrame:
    """Runs written as folders and loaded: the latest one of each model of the test split, with its users' metrics."""
    at = _at(v, "runs")
    per = stored(scorers.evaluate(v.runs("l1_order", "popularity"), v.eval_positives("test")))
    for k, (model, split) in enumerate((("l1_order", "test"), ("popularity", "test"), ("popularity", "valid"))):
        own = per.where(F.col("model") == model).drop("model")
        sinks.write_run(at, f"2024010{k}T000000Z-{model}", {"model": model, "split": split, "setting": "full", "started_at": f"2024-01-0{k}"}, own, v.run(model), {"none": 0})
    manifests, rows = readers.load_runs(v.spark, at)
    latest = report.latest_runs(report.select_runs(manifests, "test", setting="full"))
    return rows.join(latest.select("run_id", "model", "started_at"), "run_id").select("run_id", "model", "started_at", "user_id", F.col("`ndcg@10`").alias("ndcg_10"))


_sql("run_folder", "select case model when 'l1_order' then '20240100' else '20240101' end || 'T000000Z-' || model as run_id, model, case model when 'l1_order' then '2024-01-00' else '2024-01-01' end as started_at, user_id, round(ndcg_10, 6) + 0.0 as ndcg_10 from per_user where model in ('l1_order', 'popularity')")


@query
def run_selection(v: View) -> DataFrame:
    """Events as runs: those of a split, a cohort, a setting and a list length; the latest of each model but one."""
    e = v.table("events").select(F.col("event_type").alias("model"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 2 == 0, "test").otherwise("valid").alias("split"), F.when(F.col("event_id") % 3 == 0, "conditional").alias("eval_cohort"), F.when(F.col("event_id") % 5 == 0, "judged").otherwise("retrieved").alias("setting"), F.when(F.col("event_id") % 7 == 0, 50).otherwise(100).alias("top_m"))
    return report.latest_runs(report.select_runs(e, "test", "all", "retrieved", 100), ("click",)).select("model", "run_id", "started_at")


_sql("run_selection", "select event_type as model, event_id as run_id, ts as started_at from events where event_id % 2 = 0 and event_id % 3 <> 0 and event_id % 5 <> 0 and event_id % 7 <> 0 and event_type <> 'click' qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1")


@query
def csv_grid(v: View) -> DataFrame:
    """The tuning grid through a CSV file."""
    at = _at(v, "grid.csv")
    sinks.write_csv(fusion.tune(v.run("random"), v.run("popularity"), v.eval_positives("test")).withColumn("ndcg_10", F.round("ndcg_10", 6)), at, "w")
    return v.spark.read.schema("w double, ndcg_10 double, chosen boolean").csv(at, header=True)


ORACLE_SQL["csv_grid"] = ORACLE_SQL["rrf_tuning"]


@query
def report_json(v: View) -> DataFrame:
    """A preparation report through a JSON file."""
    at = _at(v, "report.json")
    sinks.write_report(v.spark, at, cohort=v.cohort("test").agg(F.count("*").alias("users"), F.sum("n_pos").alias("positives")), split="test", m=100)
    return v.spark.read.schema("cohort struct<users:long,positives:long>, split string, m long").json(at).select("cohort.*", "split", "m")


_sql("report_json", "select count(*) as users, sum(n_pos)::bigint as positives, 'test' as split, 100::bigint as m from cohort_test")


def _lengths():  # noqa: ANN202
    return lambda texts: [[float(len(t)), float(len(t.split(" "))), 0.1] for t in texts]


@query
def embedding_cache(v: View) -> DataFrame:
    """Vectors of an encoder, written in half precision and read from the cache the second time."""
    at = _at(v, "vectors")
    rows = v.items().select("item_id", "title")
    sinks.cached_vectors(rows, "item_id", "title", "lengths", _lengths, at, True)
    again = sinks.cached_vectors(rows, "item_id", "title", "lengths", lambda: _fails, at, True)
    return again.select("item_id", *[F.col("v")[k].cast("double").alias(f"x{k}") for k in range(3)])


def _fails(texts: list[str]) -> list[list[float]]:
    raise AssertionError("the cache was not used")


_sql("embedding_cache", "select p_partkey as item_id, length(p_name)::double as x0, len(string_split(p_name, ' '))::double as x1, 0.099976::double as x2 from part")


@query
def first_users(v: View) -> DataFrame:
    """The pool of the first twenty users, as a smoke test takes it."""
    return scorers.first_users(v.pop_pool("test"), 20).groupBy("user_id").agg(F.count("*").alias("n"))


_sql("first_users", "select user_id, count(*) as n from pool where user_id in (select distinct user_id from pool order by user_id limit 20) group by user_id")


@query
def alignment_guard(v: View) -> DataFrame:
    """Users that runs lack against the baseline, in sound runs and in ones with a planted gap; and what the guards say."""
    runs = stored(v.runs("l1_order", "random").select("model", "user_id", "item_id").distinct())
    out = []
    for name, rows in (("sound", runs), ("planted", runs.where("model = 'l1_order' or user_id % 5 > 0"))):
        says = []
        for check in (lambda: report.check_aligned(rows.select("model", "user_id").distinct()), lambda: fusion.check_cover(*[rows.where(F.col("model") == m) for m in ("l1_order", "random")])):
            try:
                check()
                says.append("0")
            except ValueError as e:
                says.append("".join(c for c in str(e) if c.isdigit()))
        out.append((name, int(says[0]), int(says[1])))
    return v.spark.createDataFrame(out, "runs string, users_missing long, candidates_apart long")


_sql("alignment_guard", "select 'sound' as runs, 0::bigint as users_missing, 0::bigint as candidates_apart union all select 'planted', (select count(distinct user_id) from pool where user_id % 5 = 0), (select count(*) from pool where user_id % 5 = 0)")


@query
def overlap_gate(v: View) -> DataFrame:
    """Queries whose exact lists two halves of a search share, and what the gate says of it."""
    from ..operators import vectors

    near = v.knn()
    rows = []
    for name, part in (("same", near), ("half", near.where("product_id % 2 = 0"))):
        overlap = vectors.overlap_at_k(near, part, 100, item="product_id").first().overlap
        try:
            vectors.ann_gate(overlap)
            rows.append((name, overlap, True))
        except ValueError:
            rows.append((name, overlap, False))
    return v.spark.createDataFrame(rows, "search string, overlap double, passed boolean")


_sql("overlap_gate", "select 'same' as search, 1.0::double as overlap, true as passed union all select 'half', round(count(*) filter (product_id % 2 = 0) / count(*), 6) + 0.0, count(*) filter (product_id % 2 = 0) / count(*) >= 0.95 from knn")


@query
def decision_prompts(v: View) -> DataFrame:
    """What a decision model is shown: one candidate, and the first three at once."""
    pool = v.pop_pool("test").where("rank < 3").join(v.items().select("item_id", "title"), "item_id")
    one = text.decision_state(F.concat(F.lit("user "), F.col("user_id")), text.title_or_default(F.when(F.col("item_id") % 4 > 0, F.col("title"))))
    each = pool.select("user_id", "rank", F.md5(one).alias("state"))
    many = pool.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", F.col("title").alias("text")))).alias("x"))
    listed = F.transform("x", lambda x: F.struct(x["item_id"].alias("item_id"), x["text"].alias("text")))
    return each.unionByName(many.select("user_id", F.lit(-1).cast("long").alias("rank"), F.md5(text.decision_state_of_many(F.concat(F.lit("user "), F.col("user_id")), listed)).alias("state")))


_sql("decision_prompts", "select user_id, rank, md5('Shopper history' || chr(10) || 'user ' || user_id || chr(10) || chr(10) || 'Candidate product' || chr(10) || case when item_id % 4 > 0 then p_name else '(untitled)' end || chr(10)) as state from pool join part on p_partkey = item_id where rank < 3 union all select user_id, -1, md5('Shopper history' || chr(10) || 'user ' || user_id || chr(10) || chr(10) || 'Candidate products' || chr(10) || string_agg('[' || item_id || ']' || chr(10) || p_name, chr(10) || chr(10) order by rank) || chr(10)) from pool join part on p_partkey = item_id where rank < 3 group by user_id")


@query
def reply_probabilities(v: View) -> DataFrame:
    """Replies of a decision model in both their forms, made of events and parsed."""
    answer = lambda k, c: F.concat(F.lit(f'"q{k}":{{"'), F.when(F.col("event_id") % 2 == 0, "noul").otherwise("probability"), F.lit('":'), c.cast("string"), F.lit("}"))
    body = F.concat(F.lit('{"answers":{'), answer(0, F.col("event_id") % 100 / 128.0), F.lit(","), answer(1, F.lit(0.25)), F.lit("}}"))
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"result":'), body, F.lit("}"))).otherwise(body)
    return v.table("events").select("event_id", text.parse_reply(reply, 2).alias("p")).select("event_id", F.col("p")[0].alias("p0"), F.col("p")[1].alias("p1"))


_sql("reply_probabilities", "select event_id, round(event_id % 100 / 128.0::double, 6) + 0.0 as p0, 0.25::double as p1 from events")


def _draw(*parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _backend():  # noqa: ANN202
    """A backend that fails for good on some requests and once on others."""
    tried: dict = {}

    def ask(user: dict, chunk: list[dict]) -> object:
        key = (user["user_id"], chunk[0]["item_id"])
        tried[key] = tried.get(key, 0) + 1
        if _draw("fail", *key) % 11 == 0:
            raise RuntimeError(f"status {400 + _draw('status', *key) % 3}")
        if _draw("again", *key) % 7 == 0 and tried[key] == 1:
            raise scorers.RetryableError("busy")
        return [_draw("p", key[0], c["item_id"]) % 1000 / 1000 for c in chunk], f"v{_draw('version', *key) % 2}"

    return ask


def _decided(v: View) -> tuple[DataFrame, DataFrame, DataFrame]:
    score = lambda user, items: scorers.decision_scorer(_backend(), concurrency=2, sleep=lambda s: None)(user, items)
    return scorers.run_scorer(v.pop_pool("test").join(v.eval_positives("test").select("user_id").distinct(), "user_id", "left_semi"), score, [], v.eval_positives("test"))


PARTS |= {
    "asked": "select *, rank // 64 as part, first_value(item_id) over (partition by user_id, rank // 64 order by rank) as head from pool semi join evalusers using (user_id)",
    "replied": f"select *, {draw(chr(39) + 'fail' + chr(39), 'user_id', 'head')} % 11 = 0 as failed, {draw(chr(39) + 'again' + chr(39), 'user_id', 'head')} % 7 = 0 as again, 'v' || {draw(chr(39) + 'version' + chr(39), 'user_id', 'head')} % 2 as version, {draw(chr(39) + 'status' + chr(39), 'user_id', 'head')} % 3 as status from asked",
    "requests": "select distinct user_id, part, failed, again, version, status from replied",
}


@query
def decision_run(v: View) -> DataFrame:
    """A decision scorer's run: each user's failures, retries, versions and NDCG@10."""
    return _decided(v)[1].select("user_id", "failures", "retries", "versions", F.col("`ndcg@10`").alias("ndcg_10"))


_sql(
    "decision_run",
    "select user_id, failures, retries, versions, round(ndcg_10, 6) + 0.0 as ndcg_10 from per_user join (select user_id, count(*) filter (failed) as failures from replied group by user_id) a using (user_id) join (select user_id, count(*) filter (again and not failed) as retries, coalesce(string_agg(distinct version, ',' order by version) filter (not failed), '') as versions from requests group by user_id) b using (user_id)",
    {"runs": f"select 'decision' as model, user_id, item_id, rank as l1_rank, case when failed then null else {draw(chr(39) + 'p' + chr(39), 'user_id', 'item_id')} % 1000 / 1000 end as score from replied"},
)


@query
def decision_totals(v: View) -> DataFrame:
    """The run's totals, without the waits, which are random."""
    return _decided(v)[2].drop("waited_s")


_sql("decision_totals", "select (select count(*) from evalusers) as users, (select count(*) filter (failed) from replied) as failures, count(*) filter (again and not failed) as retries, string_agg(distinct version, ',' order by version) filter (not failed) as versions from requests")


@query
def decision_errors(v: View) -> DataFrame:
    """Error texts of the run and how many requests ended in them."""
    each = scorers.calls(_decided(v)[0]).select(F.explode("errors").alias("error", "n"))
    return each.groupBy("error").agg(F.sum("n").alias("n"))


_sql("decision_errors", "select 'RuntimeError: status ' || (400 + status) as error, count(*) as n from requests where failed group by 1")


@query
def pairwise_run(v: View) -> DataFrame:
    """A cross-encoder as a scorer, logits made probabilities, pairs over a length counted."""
    pool = v.pop_pool("test").where("rank < 20").join(v.items().select("item_id", "title"), "item_id").withColumn("profile", F.concat(F.lit("user "), F.col("user_id")))
    score = lambda user, items: scorers.pairwise_scorer(lambda pairs: [len(b) - 20.0 for _, b in pairs], text="title", batch=7, most_tokens=4)(user, items)
    return scorers.apply_scorer(pool, score, ["title", "profile"]).select("user_id", "item_id", "l1_rank", "score", "over_length")


_sql("pairwise_run", "select user_id, item_id, rank as l1_rank, round(1 / (1 + exp(20.0 - length(p_name))), 9) + 0.0 as score, sum((len(string_split(p_name, ' ')) + 2 > 4)::int) over (partition by user_id)::bigint as over_length from pool join part on p_partkey = item_id where rank < 20")


@query
def listwise_run(v: View) -> DataFrame:
    """A model asked once about all of a user's candidates, which leaves some without a reply."""
    pool = v.pop_pool("test").where("rank < 20").join(v.items().select("item_id", "title"), "item_id")
    reply = lambda user, texts: [{"index": i, "score": len(t) / 64} for i, t in reversed(list(enumerate(texts))) if len(t) % 4]
    scored = scorers.apply_scorer(pool, lambda user, items: scorers.listwise_scorer(reply, "title")(user, items), ["title"])
    return scored.select("user_id", "item_id", "l1_rank", F.nanvl("score", F.lit(None).cast("double")).alias("score"), "failures")


_sql("listwise_run", "select user_id, item_id, rank as l1_rank, case when length(p_name) % 4 > 0 then round(length(p_name) / 64, 9) + 0.0 end as score, count(*) filter (length(p_name) % 4 = 0) over (partition by user_id) as failures from pool join part on p_partkey = item_id where rank < 20")


@query
def fused_run(v: View) -> DataFrame:
    """Fusion tuned on one run's users and applied to another's: weight, and metrics of each user."""
    runs = [v.run("random"), v.run("popularity")]
    pos = v.eval_positives("test")
    part = lambda k: [r.where(F.col("user_id") % 2 == k) for r in runs]
    own = lambda k: pos.where(F.col("user_id") % 2 == k)
    w, _, per_user = fusion.fuse_run(tuple(part(0)), tuple(part(1)), own(0), own(1))
    return per_user.select("user_id", F.lit(w).alias("w"), *[F.col(f"`{m}`").alias(m.replace("@", "_")) for m in metrics.BINARY[:3]])


_HALVES = {
    "base": "select model, user_id, item_id, l1_rank, row_number() over (partition by model, user_id order by score desc, l1_rank, item_id) as r from base_runs where model in ('random', 'popularity')",
    "base_runs": PARTS["runs"],
    "grid": "select w, user_id, item_id, a.l1_rank, w / (60 + a.r) + (1.0::double - w) / (60 + b.r) as score from base a join base b using (user_id, item_id), (select i / 10 as w from range(0, 11) t(i)) g where a.model = 'random' and b.model = 'popularity'",
    "runs": "select w::varchar as model, user_id, item_id, l1_rank, score from grid",
    "weight": "select model from per_user where user_id % 2 = 0 group by model order by round(avg(ndcg_10), 12) desc, model limit 1",
}
_sql("fused_run", f"select user_id, model::double as w, {r6('ndcg_10', 'precision_10', 'precision_30')} from per_user where user_id % 2 = 1 and model = (select model from weight)", _HALVES)


@query
def channel_positives(v: View) -> DataFrame:
    """Which channel the positives of the merged pool came from."""
    return report.positives_by_channel(v.merged("test"), v.positives("test"))


_sql("channel_positives", "select source, count(*) as positives, round(count(*) / sum(count(*)) over (), 6) + 0.0 as share from merged semi join positives_test using (user_id, item_id) group by source")


@query
def run_costs(v: View) -> DataFrame:
    """What a thousand queries of each model cost."""
    e = v.table("events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("queries"), F.sum(F.length("props")).alias("tokens"))
    return e.select("model", "queries", report.cost_per_thousand(text.cost(F.col("tokens"), 0.042), F.col("queries")).alias("usd_per_1000"))


_sql("run_costs", "select event_type as model, count(*) as queries, round(1000 * (sum(length(props)) * 0.042::double / 1e6) / count(*), 6) + 0.0 as usd_per_1000 from events group by event_type")


@query
def entity_text(v: View) -> DataFrame:
    """Named and numbered entities, decoded once."""
    given = F.concat(F.lit("caf&eacute; &#233;&#xe9; &amp;lt; &nosuch; &lt;b&gt; R&amp;D "), F.col("page_id"), F.lit("<br>&hellip;&Auml;&"))
    return v.table("pages").select("page_id", text.clean_html(given).alias("text"))


_sql("entity_text", "select page_id, 'café éé &lt; &nosuch; <b> R&D ' || page_id || ' …Ä&' as text from pages")


@query
def item_texts(v: View) -> DataFrame:
    """Items cleaned, rendered and cut, with the default title where there is none."""
    fields = {"title": F.when(F.col("item_id") % 5 > 0, F.col("title")), "description": F.concat(F.lit("<p>"), F.col("title"), F.lit("</p> &amp; more")), "store": F.col("store")}
    return v.items().select("item_id", text.item_text(fields, 12).alias("c")).select("item_id", "c.text", "c.truncated", "c.n_tokens")


def _item_texts_sql() -> str:
    from .oracle import cut

    return f"select item_id, {cut('t', 12)} from (select p_partkey as item_id, 'Title: ' || case when p_partkey % 5 > 0 then p_name else '(untitled)' end || chr(10) || 'Description: ' || p_name || ' & more' || chr(10) || 'Store: ' || p_brand as t from part) x"


ORACLE_SQL["item_texts"] = _item_texts_sql()


@query
def subword_budget(v: View) -> DataFrame:
    """Texts kept up to a budget of a tokenizer's pieces, here of four characters."""
    pieces = lambda t: [(i, min(i + 4, len(t))) for i in range(0, len(t), 4)]
    return v.table("documents").select("doc_id", text.subword_cut(F.col("text"), 50, pieces).alias("c")).select("doc_id", F.md5("c.text").alias("text"), "c.truncated", "c.n_tokens")


ORACLE_SQL["subword_budget"] = "select doc_id, md5(coalesce(substr(text, 1, 200), '')) as text, length(coalesce(text, '')) > 200 as truncated, least(50, ceil(length(coalesce(text, '')) / 4))::bigint as n_tokens from documents"


@query
def prompt_templates(v: View) -> DataFrame:
    """Queries under their prompt, and the digest by which a cached encoder is known."""
    rows = v.search_queries().select("query_id", F.concat(F.lit(text.query_prompt()), F.lit("query "), F.col("query_id")).alias("prompt"))
    return rows.select("query_id", F.sha2("prompt", 256).alias("digest"))


_sql("prompt_templates", f"select query_id, sha256('Instruct: {text.QUERY_INSTRUCTION}' || chr(10) || 'Query:' || 'query ' || query_id) as digest from queries")


@query
def pool_files(v: View) -> DataFrame:
    """Files of a frozen table by their own digests: each is there once, and as many rows as were frozen are in them."""
    at = _at(v, "pool")
    pools.freeze(v.pop_pool("test"), at)
    files = pools.file_digests(v.spark, at).agg((F.count("*") == F.countDistinct("path")).alias("each_once"), (F.min(F.length("sha256")) == 64).alias("digests"))
    return files.crossJoin(v.spark.read.parquet(at).agg(F.count("*").alias("rows")))  # one row each


_sql("pool_files", "select true as each_once, true as digests, count(*) as rows from pool")


@query
def profile_vectors_fallback(v: View) -> DataFrame:
    """Users of the test cohort by whether any liked item stands behind their vector."""
    return v.users("test").groupBy("fallback").agg(F.count("*").alias("users"))


_sql("profile_vectors_fallback", "select fallback, count(distinct user_id) as users from liked_test join item_vecs using (item_id) group by fallback")

