import datetime as dt
import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.functions import hashing, text
from rankloom.operators import channels, pools, report, scorers, timeline, vectors
from rankloom.sources import readers, sinks
from rankloom.storage import drop_stored, stored

Q = dt.datetime(2001, 1, 1)
LOG = "user_id string, item_id string, rating int, ts timestamp_ntz"


def day(n):
    return Q + dt.timedelta(days=n)


def lists(spark, **named):
    out = {}
    for name, items in named.items():
        out[name] = spark.createDataFrame([("u", Q, i, x) for i, x in enumerate(items)], "user_id string, query_time timestamp_ntz, rank long, item_id long")
    return out


def test_interleave(spark):
    both = lists(spark, x=[0, 1, 2, 3], y=[1, 4, 5])
    got = [(r.item_id, r.source) for r in channels.interleave(both, 5).orderBy("rank").collect()]
    assert got == [(0, "x"), (1, "y"), (2, "x"), (4, "y"), (3, "x")]
    assert [r.item_id for r in channels.interleave(both, 4, {"y": 1}).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r.item_id for r in channels.interleave(lists(spark, x=[7], y=[7, 8]), 9).orderBy("rank").collect()] == [7, 8]


def test_interleave_equals_a_loop(spark):
    rnd = random.Random(1)
    named = {c: rnd.sample(range(15), rnd.randint(1, 12)) for c in "abc"}
    quotas = {"a": 2}
    seen, out, at = [], [], dict.fromkeys(named, 0)
    while len(out) < 9:
        before = len(out)
        for c, row in named.items():
            if len(out) >= 9 or sum(s == c for _, s in out) >= quotas.get(c, 9):
                continue
            rest = [x for x in row if x not in seen]
            if rest:
                seen.append(rest[0])
                out.append((rest[0], c))
        if len(out) == before:
            break
    assert at and [(r.item_id, r.source) for r in channels.interleave(lists(spark, **named), 9, quotas).orderBy("rank").collect()] == out


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def cohort(spark, *users):
    return spark.createDataFrame([(u, Q) for u in users], "user_id string, query_time timestamp_ntz")


def test_popularity_window_edges(spark):
    r = log(spark, [("a", "i", 1, day(-90)), ("b", "i", 5, day(-1)), ("c", "i", 5, day(-91)), ("d", "i", 5, day(0)), ("a", "j", 2, day(-90.001))])
    got = {x.item_id: x.score for x in channels.popularity(r, cohort(spark, "a")).collect()}
    assert got == {"i": 2.0}


def test_shared_top_lists(spark):
    r = log(spark, [("a", "i1", 5, day(-9)), ("b", "i2", 5, day(-8)), ("b", "i2", 5, day(-7)), ("c", "i3", 5, day(-200)), ("c", "i4", 5, day(1))])
    c = cohort(spark, "a", "b")
    args = (channels.popularity(r, c), c, timeline.first_seen(r), timeline.seen_pairs(r, c))
    got = {(x.user_id, x.rank): (x.item_id, x.l1_score) for x in channels.topm_shared(*args, 2).collect()}
    # i4 comes later; own items are out; items without an event in the window count 0
    assert got == {("a", 0): ("i2", 2.0), ("a", 1): ("i3", 0.0), ("b", 0): ("i1", 1.0), ("b", 1): ("i3", 0.0)}
    pool = channels.topm_shared(*args, 2)
    assert pools.check_pools(pool, r, timeline.first_seen(r)) == []
    bad = pool.unionByName(spark.createDataFrame([("a", Q, 5, "i1", 0.0), ("a", Q, 6, "i4", 0.0), ("a", Q, 7, "i2", 0.0)], pool.schema))
    assert [m.split()[0] for m in pools.check_pools(bad, r, timeline.first_seen(r))] == ["1", "1", "1", "1"]


def test_cooccurrence(spark):
    r = log(spark, [("u", "a", 5, day(-5)), ("v", "a", 1, day(-9)), ("v", "b", 5, day(-8)), ("v", "b", 5, day(-8)), ("w", "a", 5, day(-3)), ("w", "c", 5, day(2))])
    c = cohort(spark, "u")
    sim = {(x.i, x.j): x.sim for x in channels.cooccurrence(r, c).collect()}
    assert set(sim) == {("a", "b"), ("b", "a")}  # c comes after the query time
    assert sim["a", "b"] == pytest.approx(1 / math.sqrt(3), abs=1e-6)
    weights = channels.liked_weights(r, c, 10)
    got = channels.cooccurrence_scores(channels.cooccurrence(r, c, weights), weights).collect()
    assert [(x.user_id, x.item_id) for x in got] == [("u", "b")]
    assert got[0].score == pytest.approx(0.5**0.5 / math.sqrt(3), abs=1e-6)


def test_cooccurrence_of_a_user_of_many_items(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [("hub", f"i{k}", 5, day(-3)) for k in range(60)] + [(f"u{k}", f"i{rnd.randrange(80)}", 5, day(-2)) for k in range(150)]
    r, c = log(spark, rows), cohort(spark, "hub")
    found = lambda *w: sorted((x.i, x.j, round(x.sim, 9)) for x in channels.cooccurrence(r, c, *w).collect())
    whole = found()
    monkeypatch.setattr(channels, "PAIR_BLOCK", 7)
    assert found() == whole and len(whole) >= 60 * 59
    some = spark.createDataFrame([(Q, "i3"), (Q, "i70")], "query_time timestamp_ntz, i string")
    assert found(some) == [x for x in whole if x[0] in ("i3", "i70")]


def test_cooccurrence_lists_leave_no_row_for_each_user_and_neighbour(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [("hub", f"i{k:02}", 5, day(-3)) for k in range(50)] + [(f"u{k:02}", f"i{rnd.randrange(70):02}", rnd.randint(1, 5), day(-rnd.randrange(90) - 0.5)) for k in range(40) for _ in range(rnd.randint(1, 9))]
    r = log(spark, rows).cache()
    c = spark.createDataFrame([("hub", Q)] + [(f"u{k:02}", day(-20 * (k % 2))) for k in range(30)], "user_id string, query_time timestamp_ntz")
    weights = channels.liked_weights(r, c)
    scores = channels.cooccurrence_scores(channels.cooccurrence(r, c, weights), weights).withColumn("score", F.round("score", 9))
    want = sorted(map(tuple, channels.topm_from_scores(scores, c, timeline.first_seen(r), timeline.seen_pairs(r, c), 7).collect()))
    assert len(want) > 100
    # Few users a block, few entries a task (items dealt to several), few contributions at a time (hot items counted once).
    for users, entries, step, hot in ((32768, 6_000_000, 1_000_000, 64 << 20), (5, 60, 50, 0), (9, 10**6, 90, 600)):
        for name, value in zip(("LIST_USERS", "LIST_ENTRIES", "LIST_STEP", "HOT_BYTES"), (users, entries, step, hot), strict=True):
            monkeypatch.setattr(channels, name, value)
        assert sorted(map(tuple, channels.cooccurrence_topm(r, c, 7).collect())) == want
    assert channels.cooccurrence_topm(r, c.limit(0), 7).count() == 0


def test_shared_top_lists_at_many_query_times(spark, monkeypatch):
    rnd = random.Random(4)
    events = [(f"u{rnd.randrange(12)}", f"i{rnd.randrange(30):02}", rnd.randint(1, 5), day(-rnd.randrange(200) - 0.5)) for _ in range(160)]
    users = [(f"u{k}", day(-rnd.randrange(3) * 20)) for k in range(12)]
    r, c = log(spark, events), spark.createDataFrame(users, "user_id string, query_time timestamp_ntz")
    first, seen = timeline.first_seen(r), timeline.seen_pairs(r, c)
    want = []
    born = {i: min(t for _, j, _, t in events if j == i) for _, i, _, _ in events}
    for u, q in users:
        own = {i for v, i, _, t in events if v == u and t < q}
        count = {i: sum(j == i and q - dt.timedelta(days=90) <= t < q for _, j, _, t in events) for i in born}
        best = sorted((i for i in born if born[i] < q and i not in own), key=lambda i: (-count[i], i))[:9]
        want += [(u, k, i, float(count[i])) for k, i in enumerate(best)]
    for most in (channels.BROADCAST_ROWS, 0):
        monkeypatch.setattr(channels, "BROADCAST_ROWS", most)
        got = channels.topm_shared(channels.popularity(r, c), c, first, seen, 9).collect()
        assert sorted((x.user_id, x.rank, x.item_id, x.l1_score) for x in got) == sorted(want)
    late = {x.query_time: x.n_late for x in vectors.count_from(first, c.select("query_time").distinct()).collect()}
    assert late == {q: sum(t >= q for t in born.values()) for _, q in users}


def test_cohort_counts_rows_and_respects_edges(spark):
    q = dt.datetime(2001, 1, 1)
    rows = [("u", f"i{k}", 1, q - dt.timedelta(days=k)) for k in (1, 2, 3)] + [("u", "p", 4, q), ("u", "p", 5, q), ("v", "x", 5, q), ("w", "a", 1, q - dt.timedelta(days=1)), ("w", "b", 5, q)]
    r = log(spark, rows)
    assert [(x.user_id, x.n_prior, x.n_pos) for x in timeline.select_cohort(r, "test").collect()] == [("u", 3, 2)]
    assert {(x.user_id, x.item_id) for x in timeline.positives(r, "test").collect()} == {("u", "p"), ("v", "x"), ("w", "b")}
    assert timeline.select_cohort(r, "test", min_prior=0, n_users=2).count() == 2
    with pytest.raises(ValueError):
        timeline.window("train")


def test_user_vectors_fall_back_and_normalise(spark):
    r = log(spark, [("u", "a", 5, day(-10)), ("u", "b", 1, day(-1)), ("v", "b", 1, day(-1)), ("v", "b", 2, day(-1))])
    iv = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "item_id string, v array<double>")
    got = {x.user_id: (x.fallback, list(x.v)) for x in vectors.user_vectors(r, cohort(spark, "u", "v"), iv).collect()}
    assert got["u"] == (False, pytest.approx([0.6, 0.8])) and got["v"] == (True, pytest.approx([0.0, 1.0]))
    with pytest.raises(ValueError):
        vectors.require_vectors(cohort(spark, "u", "z"), vectors.user_vectors(r, cohort(spark, "u"), iv))


def unit(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vec_frame(spark, name, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} long, v array<double>")


def test_blocked_topk_equals_brute_force(spark):
    a, b = unit(7, 16, 0), unit(537, 16, 1)
    b[10] = b[3]
    q, i = vec_frame(spark, "query_id", a), vec_frame(spark, "item_id", b)
    for sizes in ((1024, 16384), (3, 100)):
        got = {(r.query_id, r.rank): r.item_id for r in vectors.exact_topk(q, i, 20, query_block=sizes[0], item_block=sizes[1]).collect()}
        for k in range(7):
            s = np.round(a[k] @ b.T, 9)
            assert [got[k, r] for r in range(20)] == sorted(range(537), key=lambda j: (-s[j], j))[:20]
    ties = np.array([[3e9, 1, 3e9, 2], [0, 0, 0, 0]])
    assert vectors.best_of(ties, 3).tolist() == vectors.best_of(ties / 1e9, 3).tolist() == [[0, 2, 3], [0, 1, 2]]
    assert vectors.exact_topk(q, i.limit(5), 9).count() == 7 * 5


def test_codes_and_the_gate(spark):
    a, b = unit(20, 16, 2), unit(1500, 16, 3)
    q, i = vec_frame(spark, "query_id", a), vec_frame(spark, "item_id", b)
    exact = vectors.exact_topk(q, i, 10)
    near = vectors.code_topk(q, i, 10, 16).cache()
    assert near.count() == 20 * 40
    planes = vectors.code_planes(512, 16)
    bits = lambda x: np.round(x @ planes.T, 9) >= 0
    far = (bits(a)[:, None, :] != bits(b)[None, :, :]).sum(axis=2)
    for k in range(20):
        want = sorted(range(1500), key=lambda j: (far[k, j], j))[:40]
        assert sorted(r.item_id for r in near.where(F.col("query_id") == k).collect()) == sorted(want)
    overlap = vectors.overlap_at_k(exact, near, 10).first().overlap
    vectors.ann_gate(overlap)
    with pytest.raises(ValueError):
        vectors.ann_gate(0.9)


def test_approximate_lists_compare_equal_vectors_once(spark, monkeypatch):
    rnd, a, b = random.Random(9), unit(140, 16, 4), unit(23, 16, 5)
    users = spark.createDataFrame([(f"u{k:03}", day(-(k % 3)), a[k].tolist()) for k in range(140)], "user_id string, query_time timestamp_ntz, v array<double>").cache()
    items = spark.createDataFrame([(f"i{k:03}", b[k % 23].tolist()) for k in range(300)], "item_id string, v array<double>").cache()
    first = spark.createDataFrame([(f"i{k:03}", day(-rnd.randrange(3))) for k in range(280)], "item_id string, first_seen timestamp_ntz")
    seen = spark.createDataFrame([(f"u{k % 100:03}", f"i{rnd.randrange(300):03}") for k in range(900)], "user_id string, item_id string").distinct().cache()
    found = []
    for rows in (0, 1_000_000):  # item by item; then equal vectors once, without code_topk
        monkeypatch.setattr(vectors, "ITEM_ROWS", rows)
        lists, short = vectors.approximate_topm(users, items, first, seen, 10, 16)
        found.append((sorted(map(tuple, lists.collect())), sorted(map(tuple, short.collect()))))
        monkeypatch.setattr(vectors, "code_topk", None)
    assert found[0] == found[1] and len(found[0][0]) > 500 and found[0][1]


def test_freeze_verifies_content(spark, tmp_path):
    pool = spark.createDataFrame([("u", Q, k, f"i{k}", 1.0 / (k + 1)) for k in range(5)], "user_id string, query_time timestamp_ntz, rank long, item_id string, l1_score double")
    at = f"file://{tmp_path}/pool"
    digest = pools.freeze(pool, at)
    rows, again = pools.load_frozen(spark, at, 3)
    assert again == digest == hashing.content_digest(pool.repartition(3), "user_id").first().digest and rows.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        pools.freeze(pool, at)
    with pytest.raises(ValueError):
        pools.freeze(pool.drop("rank"), at + "2")
    assert pools.file_digests(spark, at).count() >= 1
    pool.limit(4).write.mode("overwrite").parquet(at)
    with pytest.raises(ValueError):
        pools.load_frozen(spark, at)
    assert pools.check_item_fields(spark.createDataFrame([(1, 2)], "a int, images int"))


def test_readers(spark, tmp_path):
    for split, rows in dict(train=[("u", "a", 5, 1), ("u", "a", 5, 1), ("u", "b", 1, 2)], valid=[("u", "a", 3, 1), ("v", "c", 4, 3)], test=[]).items():
        with gzip.open(f"{tmp_path}/C.{split}.csv.gz", "wt") as f:
            f.write("user_id,parent_asin,rating,timestamp,history\n" + "".join(f"{a},{b},{c},{d},x y\n" for a, b, c, d in rows))
    got = readers.load_ratings(spark, str(tmp_path), "C")
    assert sorted(map(tuple, got.collect())) == [("u", "a", 5.0, 1, "train"), ("u", "b", 1.0, 2, "train"), ("v", "c", 4.0, 3, "valid")]
    with gzip.open(f"{tmp_path}/meta_C.jsonl.gz", "wt") as f:
        for d in ({"parent_asin": "a", "title": "T", "images": [1], "features": ["x", ""]}, {"parent_asin": "a", "title": "U"}, {"parent_asin": "z"}):
            f.write(json.dumps(d) + "\n")
    meta = readers.load_meta(spark, str(tmp_path), got, "C").collect()
    assert len(meta) == 1 and meta[0].title == "T" and meta[0].price is None and "images" not in meta[0].asDict()
    ex = spark.createDataFrame([(1, "  q ", "p", "us", "E", 1, "test"), (1, "q", "p", "es", "E", 1, "test"), (2, "q", "p", "us", "E", 0, "test")], schemas.EXAMPLES)
    ex.write.parquet(f"{tmp_path}/ex")
    assert [(r.query_id, r["query"]) for r in readers.load_examples(spark, f"{tmp_path}/ex").collect()] == [(1, "q")]
    spark.createDataFrame([("p", "t", None, None, None, None, "us"), ("p", "t", None, None, None, None, "us"), ("q", "t", None, None, None, None, "jp")], schemas.PRODUCTS).write.parquet(f"{tmp_path}/pr")
    assert readers.load_products(spark, f"{tmp_path}/pr", "us", spark.createDataFrame([("p",)], "product_id string")).count() == 1
    for run in ("r1", "r2"):
        spark.createDataFrame([("u", 0.5)], "user_id string, x double").write.parquet(f"{tmp_path}/runs/{run}/per_user.parquet")
    (tmp_path / "runs/r1/manifest.json").write_text(json.dumps({"model": "m", "started_at": "2024"}))
    manifests, per_user = readers.load_runs(spark, f"{tmp_path}/runs")
    assert [(r.run_id, r.model) for r in manifests.collect()] == [("r1", "m")] and [r.run_id for r in per_user.collect()] == ["r1"]


def test_latest_runs_and_guards(spark):
    m = spark.createDataFrame([("a", "r1", "1", "h", 0), ("a", "r2", "2", "h", 5), ("a", "r3", "1", "h", None), ("b", "r4", "1", None, 0)], "model string, run_id string, started_at string, pool_sha256 string, limit_users int")
    assert sorted((r.model, r.run_id) for r in report.latest_runs(m).collect()) == [("a", "r3"), ("b", "r4")]
    with pytest.raises(ValueError):
        report.check_one_hash(m, "pool_sha256")
    per = spark.createDataFrame([("l1_order", "u"), ("l1_order", "v"), ("m", "u")], "model string, user_id string")
    with pytest.raises(ValueError):
        report.check_aligned(per)
    report.check_aligned(per.where("user_id = 'u'"))
    with pytest.raises(ValueError):
        report.check_aligned(per.where("model = 'm'"))
    runs = m.withColumn("split", F.lit("test")).withColumn("eval_cohort", F.lit(None).cast("string"))
    assert report.select_runs(runs, "test", "all").count() == 4 and report.select_runs(runs, "valid").count() == 0


def pool3(spark):
    return spark.createDataFrame([("u", k, f"i{k}") for k in range(3)], "user_id string, rank int, item_id string")


def test_scorer_contract(spark):
    ok = scorers.apply_scorer(pool3(spark), lambda u, c: [float(len(c) - x["rank"]) for x in c], []).orderBy("l1_rank").collect()
    assert [r.score for r in ok] == [3.0, 2.0, 1.0]
    for bad in (lambda u, c: [float("nan"), 1.0, 1.0], lambda u, c: [1.0], lambda u, c: [float("inf")] * 3, lambda u, c: ["x"] * 3):
        with pytest.raises(Exception, match="ContractError|scores"):
            scorers.apply_scorer(pool3(spark), bad, []).collect()


def test_decision_scorer_fails_by_chunk():
    def backend(user, chunk):
        if any(c["item_id"] == "i1" for c in chunk):
            raise scorers.RetryableError
        return [1.0] * len(chunk)

    given = [{"item_id": f"i{k}"} for k in range(5)]
    got = scorers.decision_scorer(backend, questions=2, most=1, sleep=lambda s: None)({"user_id": "u"}, given)
    assert [math.isnan(x) for x in got] == [True, True, False, False, False]


def test_decision_scorer_tells_what_happened():
    tried = []

    def backend(user, chunk):
        tried.append(chunk[0]["item_id"])
        if chunk[0]["item_id"] == "i0" and tried.count("i0") < 3:
            raise scorers.RetryableError("busy")
        if chunk[0]["item_id"] == "i4":
            raise KeyError("lost")
        return [0.5] * len(chunk), "v1"

    given = [{"item_id": f"i{k}"} for k in range(5)]
    got = scorers.decision_scorer(backend, questions=2, concurrency=1, base=1, sleep=lambda s: None, rng=random.Random(0))({"user_id": "u"}, given)
    assert (got.failures, got.retries, got.versions, got.errors) == (1, 2, ["v1"], {"KeyError: 'lost'": 1}) and got.waited > 0
    asked = []
    scorers.decision_scorer(lambda u, c: asked.extend(x["item_id"] for x in c) or [1.0] * len(c), concurrency=1, shuffle_seed=3)({}, given)
    order = list(range(5))
    random.Random(3).shuffle(order)
    assert asked == [f"i{k}" for k in order]


def test_answers_keep_the_contract():
    nan = float("nan")
    assert list(scorers.checked([1.0, 2.0], 2)) == [1.0, 2.0]
    assert scorers.checked(scorers.Answer([nan, 1.0], failures=1), 2).failures == 1
    for bad, n in (([], 0), ([nan], 1), (scorers.Answer([nan, nan], failures=1), 2), ([1], 1)):
        with pytest.raises(scorers.ContractError):
            scorers.checked(bad, n)


def test_backends_and_models():
    with pytest.raises(NotImplementedError):
        scorers.make_backend("nowhere")({}, [{}])
    sent = []
    ask = scorers.http_backend(lambda r: (sent.append(r), (200, json.dumps({"result": {"model": "m-1", "answers": {"q0": {"noul": 0.2}, "q1": {"probability": 0.9}}, "usage": {"input_tokens": 7}}})))[1], lambda u, c: "state", "m-1")
    assert ask({}, [{"item_id": 1}, {"item_id": 2}]) == ([0.2, 0.9], "m-1") and ask.tokens == 7 and "candidate 2" in sent[0]["questions"]["q1"]
    busy = scorers.http_backend(lambda r: (529, ""), lambda u, c: "", "m-1")
    with pytest.raises(scorers.RetryableError):
        busy({}, [{"item_id": 1}])
    assert scorers.with_overrides({"a": 1, "b": "x"}, ["a=2", "b=y z"]) == {"a": 2, "b": "y z"}
    with pytest.raises(ValueError):
        scorers.with_overrides({"a": 1}, ["c=2"])
    with pytest.raises(ValueError):
        scorers.build("nothing")


def test_run_scorer_with_another_metric(spark):
    pool = pool3(spark)
    pos = spark.createDataFrame([("u", "i2")], "user_id string, item_id string")
    _, per, totals = scorers.run_scorer(pool, lambda u, c: [0.5, 0.1, 0.9], [], pos, lambda s, p: s.groupBy("user_id").agg(F.max("score").alias("top")))
    assert [(r.user_id, r.top, r.failures) for r in per.collect()] == [("u", 0.9, 0)] and totals.first().users == 1
    ranked = scorers.build("pairwise", predict=lambda pairs: [float(len(b)) for _, b in pairs], profile="item_id", text="item_id", squash=False, columns=[])(pool)
    assert {r.score for r in ranked.collect()} == {2.0}


def test_half_precision_equals_numpy(spark):
    values = [0.0, 1.0, -2.5, 0.1, 1 / 3, 65504.0, 1e-5, 6e-8, -1234.567, 2049.0]
    got = spark.createDataFrame([(values,)], "v array<double>").select(sinks.half(F.col("v")).alias("h")).first().h
    assert got == [float(np.float16(x)) for x in values]


def test_every_entity_is_decoded_once(spark):
    import html

    given = ["&eacute;&Eacute; &#233;&#xE9;&#x1F600; &amp;amp; &nope; & &lt;i&gt; a&b; &NotEqualTilde; &nbsp;x", "none", "&", "&;", "&#99999999;", "&#xD800;"]
    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string").orderBy("k").select(text.clean_html(F.col("t")).alias("x")).collect()]
    assert got == [" ".join(html.unescape(given[0]).split()), *given[1:]]  # what is no character stays


def test_retries():
    calls, waits = [], []

    def ask():
        calls.append(1)
        if len(calls) < 4:
            raise scorers.RetryableError
        return "x"

    assert scorers.with_retries(ask, base=1, cap=3, sleep=waits.append, rng=random.Random(0))[:2] == ("x", 3)
    assert all(0 <= w <= min(3, 2**k) for k, w in enumerate(waits))
    with pytest.raises(KeyError):
        scorers.with_retries(lambda: {}["a"])


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.clean_html(F.col("a")), a="<b>x&nbsp;&amp;lt;</b>  y ") == "x &lt; y"
    assert one(spark, text.clean_html(F.col("a"), True), a="caf&eacute;<br>&amp;lt; ") == "café &lt;"
    c = one(spark, text.cut(F.col("a"), 3), a="a b c d e")
    assert (c.text, c.truncated, c.n_tokens) == ("a b c", True, 3)
    c = one(spark, text.cut(F.col("a"), 5), a=" a  b ")
    assert (c.text, c.truncated, c.n_tokens) == (" a  b ", False, 2)
    fields = {"title": F.col("t"), "categories": F.array_join(text.clean_list(F.col("c")), "; "), "price": F.lit(None)}
    assert one(spark, text.render_item(fields), t="Zelda", c=["Games", "", "Switch"]) == "Title: Zelda\nCategories: Games; Switch"
    assert one(spark, text.item_attrs(F.col("c"), F.col("s")), c=["Video Games", "Switch"], s="Shop") == ["Switch", "Shop"]
    for x, want in ((5.0, "5"), (10.0, "10"), (4.5, "4.5"), (0.0, "0")):
        assert one(spark, text.general(F.col("a")), a=x) == want
    assert one(spark, text.signed(F.col("a")), a=0.5) == "+0.5000" and one(spark, text.plain(F.lit(None)), a=1) == "—"
    assert one(spark, text.cost(F.col("a"), 0.24), a=2_000_000) == pytest.approx(0.48)
    assert text.query_prompt("find") == "Instruct: find\nQuery:"


def test_replies(spark):
    inner = {"answers": {"q0": {"noul": 0.2}, "q1": {"probability": 0.7}}}
    for body in (inner, {"result": inner}):
        assert one(spark, text.parse_reply(F.col("a"), 2), a=json.dumps(body)) == [0.2, 0.7]
    with pytest.raises(Exception, match="no answer"):
        one(spark, text.parse_reply(F.col("a"), 3), a=json.dumps(inner))


def test_profiles(spark):
    h = spark.createDataFrame([("u", "a", 5, day(-1)), ("u", "b", 4, day(-2)), ("u", "c", 3, day(-2)), ("v", "z", 1, day(-1))], LOG)
    items = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", "B", [])], "item_id string, title string, attrs array<string>")
    got = {r.user_id: r for r in text.build_profiles(h, items).collect()}
    assert got["u"].text == "Items this shopper rated highly:\n- A (rated 5) | x; y\n- B (rated 4)\nItems this shopper rated low:\n- (none)"
    assert got["v"].text.endswith("- (unknown) (rated 1)") and (got["u"].n_prior, got["u"].n_liked, got["v"].n_disliked) == (3, 2, 1)


def test_draws_are_those_of_md5(spark):
    assert one(spark, hashing.draw(F.lit(0), F.lit(7), F.lit(3)), a=1) == 3846532526


def test_encoder_hook(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    got = scorers.encode_texts(rows, "id", "t", lambda: lambda texts: [[float(len(x))] for x in texts]).orderBy("id").collect()
    assert [list(r.v) for r in got] == [[2.0], [0.0]]


def test_stored_tables(spark):
    df = stored(spark.range(5))
    assert df.count() == 5
    drop_stored()


def test_streaming_counts_equal_batch(spark, tmp_path):
    from rankloom.streaming import windowed_popularity

    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h)) for h in range(5)] + [("b", dt.datetime(2024, 1, 3))], "item string, ts timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_popularity(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "item", length="2 hours", slide="2 hours")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("pop").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["item"], r.score) for r in spark.table("pop").collect())
    assert got == [("a", 1), ("a", 2), ("a", 2), ("b", 1)]


def test_run_folders_and_reports(spark, tmp_path):
    from rankloom.sources import sinks

    per = spark.createDataFrame([("u", 0.5)], "user_id string, x double")
    name = sinks.run_id("m", dt.datetime(2024, 5, 1, 2, 3, 4))
    assert name == "20240501T020304Z-m"
    sinks.write_run(f"file://{tmp_path}/runs", name, {"model": "m", "started_at": "2024"}, per, per, {"timeout": 2})
    manifests, found = readers.load_runs(spark, f"{tmp_path}/runs")
    assert [(r.run_id, r.model) for r in manifests.collect()] == [(name, "m")] and found.count() == 1
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_run(f"file://{tmp_path}/runs", name, {}, per, per)
    board = spark.createDataFrame([("l1_order", 0.1, None, None, None, None, None), ("m", 0.2, 0.1, 0.05, 0.15, 0.01, True)], "model string, `ndcg@10` double, diff_vs_l1 double, ci_low double, ci_high double, p_holm double, beats_l1 boolean")
    text_ = sinks.write_leaderboard(board, f"file://{tmp_path}/board")
    assert text_.splitlines()[2:] == ["| m | 0.2000 | +0.1000 [+0.0500, +0.1500] | 0.0100 | yes |", "| l1_order | 0.1000 | — | — | — |"]
    assert sinks.write_report(spark, f"file://{tmp_path}/r.json", a=per, n=3) == {"a": {"user_id": "u", "x": 0.5}, "n": 3}
    (tmp_path / "t.txt").write_text("hello")
    assert sinks.load_template(str(tmp_path / "t.txt"))[1].startswith("2cf24dba")


def test_embedding_cache_depends_on_texts(spark, tmp_path):
    from rankloom.sources import sinks

    made = lambda: lambda texts: [[float(len(x))] for x in texts]
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    for _ in range(2):
        got = sinks.cached_vectors(rows, "id", "t", "enc", made, f"file://{tmp_path}")
        assert sorted((r.id, list(r.v)) for r in got.collect()) == [(1, [2.0]), (2, [0.0])]
    keys = {sinks.cache_key(r, "id", "t", e) for r, e in ((rows, "enc"), (rows.repartition(2), "enc"), (rows, "other"), (rows.withColumn("t", F.lit("x")), "enc"))}
    assert len(keys) == 3


def test_model_hooks():
    given = [{"profile": "p", "text": t} for t in ("a", "bb", "a")]
    assert scorers.pairwise_scorer(lambda pairs: [0.0] * len(pairs), batch=2)({}, given) == [0.5] * 3
    assert scorers.yes_probability(2.0, 2.0) == 0.5 and scorers.yes_probability(0.0, 1e6) < 1e-300
    got = scorers.listwise_scorer(lambda u, t: [{"text": "a", "score": 1}, {"index": 1, "score": 2}, {"text": "zz", "score": 9}])({}, given)
    assert got[:2] == [1.0, 2.0] and math.isnan(got[2])
    with pytest.raises(ValueError):
        scorers.build("nobody")


def test_first_users(spark):
    df = spark.createDataFrame([(u, k) for u in "cab" for k in range(2)], "user_id string, k int")
    assert {r.user_id for r in scorers.first_users(df, 2).collect()} == {"a", "b"} and scorers.first_users(df, None).count() == 6
    assert scorers.build("l1_order")(df.select("user_id", F.col("k").alias("rank"), F.lit("i").alias("item_id"))).count() == 6


def test_prompts_and_status_rules(spark):
    assert one(spark, text.decision_state(F.col("a"), F.col("b")), a="P", b="I") == "Shopper history\nP\n\nCandidate product\nI\n"
    many = F.array(F.struct(F.lit(1).alias("item_id"), F.lit("x").alias("text")), F.struct(F.lit(2).alias("item_id"), F.lit("y").alias("text")))
    assert one(spark, text.decision_state_of_many(F.col("a"), many), a="P") == "Shopper history\nP\n\nCandidate products\n[1]\nx\n\n[2]\ny\n"
    assert one(spark, text.title_or_default(F.col("a")), a="") == "(untitled)"
    scorers.check_status(200)
    for status in (429, 500, 529):
        with pytest.raises(scorers.RetryableError):
            scorers.check_status(status)
    with pytest.raises(RuntimeError):
        scorers.check_status(404)
    with pytest.raises(ValueError):
        scorers.pinned("m-latest")
    with pytest.raises(ValueError):
        scorers.decision_scorer(lambda u, c: [], questions=65)


def test_tables_that_shrink_on_disk_are_not_broadcast(spark):
    from rankloom.storage import stored_rows

    lists = spark.range(1_000_000).select((F.col("id") % 5).alias("user_id"), F.lit(1).cast("long").alias("item_id"))  # 24 MB in memory, some KB as files
    other = spark.range(3_000_000).select(F.col("id").alias("user_id"))
    plan = lambda t: other.join(t, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(stored_rows(lists))
    assert "BroadcastHashJoin" in plan(stored_rows(lists.limit(100)))  # what is small still is


def test_dense_lists_score_equal_vectors_once_and_keep_ties_by_item(spark, monkeypatch):
    rng = np.random.default_rng(3)
    at, days = dt.datetime(2020, 1, 1), dt.timedelta(days=1)
    vecs = [[float(x) for x in rng.integers(-1, 2, 3)] for _ in range(12)]  # few values: many ties of different vectors too
    items = [(i, vecs[i % 12]) for i in range(300)]
    first = [(i, at + days * (i % 9)) for i in range(300)]
    users = [(u, at + days * (4 + u % 3), [float(x) for x in rng.integers(-1, 2, 3)]) for u in range(20)]
    seen = sorted({(u, int(i)) for u in range(20) for i in rng.integers(0, 300, 40)})
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((users, "user_id long, query_time timestamp_ntz, v array<double>"), (items, "item_id long, v array<double>"), (first, "item_id long, first_seen timestamp_ntz"), (seen, "user_id long, item_id long"))]
    want = []
    for u, t, v in users:
        open_ = [(-round(sum(a * b for a, b in zip(v, x, strict=True)), 9), i) for i, x in items if first[i][1] < t and (u, i) not in set(seen)]
        want += [(u, k, i, -s) for k, (s, i) in enumerate(sorted(open_)[:37])]
    for rows in (1_000_000, 90):  # one block of items, and several
        monkeypatch.setattr(vectors, "ITEM_ROWS", rows)
        got = vectors.dense_topm(*frames, 37)
        assert sorted((r.user_id, r["rank"], r.item_id, r.l1_score) for r in got.collect()) == want
    assert vectors._classes(frames[1])[1].count() == len(set(map(tuple, vecs)))


def test_dense_ranks_are_the_places_in_the_dense_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    at, days = dt.datetime(2020, 1, 1), dt.timedelta(days=1)
    vecs = [[float(x) for x in rng.integers(-1, 2, 3)] for _ in range(12)]  # many ties, of different vectors too
    items = spark.createDataFrame([(f"i{i:03}", vecs[i % 12]) for i in range(300)], "item_id string, v array<double>").cache()
    first = spark.createDataFrame([(f"i{i:03}", at + days * (i % 9)) for i in range(290)], "item_id string, first_seen timestamp_ntz").cache()
    users = spark.createDataFrame([(float(h), u, at + days * (4 + u % 3), [float(x) for x in rng.integers(-1, 2, 3)]) for u in range(20) for h in (1, 2)], "h double, user_id long, query_time timestamp_ntz, v array<double>").cache()
    pairs = lambda n, users_: spark.createDataFrame(sorted({(u, f"i{i:03}") for u in range(users_) for i in rng.integers(0, 300, n)}), "user_id long, item_id string").cache()
    seen, wanted = pairs(40, 19), pairs(60, 22)
    lists = vectors.dense_topm(users, items, first, seen, 37, "h")
    want = sorted(map(tuple, lists.join(wanted, ["user_id", "item_id"]).select("h", "user_id", "item_id", "rank").collect()))
    monkeypatch.setattr(vectors, "ROWS", 8)
    for rows, bytes_ in ((2_000_000, 32 << 20), (90, 100)):  # one block of items; several, of vectors too
        monkeypatch.setattr(vectors, "RANK_ITEMS", rows)
        monkeypatch.setattr(vectors, "ITEM_BYTES", bytes_)
        got = vectors.dense_ranks(users, items, first, seen.union(seen), wanted, 37, "h").collect()
        assert sorted(map(tuple, (r for r in got if r.item_id))) == want and len(want) > 100
        assert {r.h for r in got if not r.item_id} == {1.0, 2.0}
    every = users.select("user_id").distinct().crossJoin(items.select("item_id"))
    assert not vectors.dense_ranks(users, items, first, every, wanted, 37, "h").count()  # no list at all


def test_half_life_sweep_makes_no_lists(spark, monkeypatch):
    from rankloom.plans.queries import QUERIES

    monkeypatch.setattr(vectors, "dense_topm", None)
    assert QUERIES["half_life_sweep"](spark, "/root/testdata/sf0.001").count() == 4


def test_approximate_counts_are_the_lengths_of_the_lists(spark, monkeypatch):
    rnd, a, b = random.Random(9), unit(90, 16, 4), unit(23, 16, 5)
    users = spark.createDataFrame([(f"u{k:03}", day(-(k % 3)), a[k].tolist()) for k in range(90)] + [("none", day(0), None)], "user_id string, query_time timestamp_ntz, v array<double>").cache()
    items = spark.createDataFrame([(f"i{k:03}", b[k % 23].tolist()) for k in range(300)], "item_id string, v array<double>").cache()
    first = spark.createDataFrame([(f"i{k:03}", day(-rnd.randrange(3))) for k in range(280)], "item_id string, first_seen timestamp_ntz").cache()
    seen = spark.createDataFrame([(f"u{k % 70:03}", f"i{rnd.randrange(300):03}") for k in range(3000)], "user_id string, item_id string").distinct().cache()
    for bits, m in ((512, 10), (64, 25)):  # shorter codes: more vectors as far as the last one
        monkeypatch.setattr(vectors._class_topm, "__defaults__", (bits, False))
        lists = vectors._class_topm(users, items, first, seen, m, 16, 4 * m)
        n = {r.user_id: r["count"] for r in lists.groupBy("user_id").count().collect()}
        got = vectors.approximate_counts(users, items, first, seen.union(seen), m, 16).collect()
        assert {r.user_id: r.n for r in got} == {u.user_id: n.get(u.user_id, 0) for u in users.collect()} and len(set(n.values())) > 1
    monkeypatch.setattr(vectors._class_topm, "__defaults__", (512, False))
    want = {r.user_id: r.n for r in vectors.approximate_counts(users, items, first, seen, 10, 16).collect()}
    monkeypatch.setattr(vectors, "ITEM_ROWS", 0)  # item by item
    assert {r.user_id: r.n for r in vectors.approximate_counts(users, items, first, seen.union(seen), 10, 16).collect()} == want


def test_approximate_pool_makes_no_lists(spark, monkeypatch):
    from rankloom.plans.queries import QUERIES

    monkeypatch.setattr(vectors, "approximate_topm", None)
    assert QUERIES["approximate_pool"](spark, "/root/testdata/sf0.001").first().candidates > 0
