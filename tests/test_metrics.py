import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from rankloom import plans
from rankloom.operators import fusion, metrics, stats


def run(spark, ranked, positives):
    scores = spark.createDataFrame([("u", x, i, -float(i)) for i, x in enumerate(ranked)], "user_id string, item_id string, l1_rank int, score double")
    pos = spark.createDataFrame([("u", x) for x in positives], "user_id string, item_id string")
    return metrics.per_user_metrics(scores, pos).first().asDict()


def test_binary_golden_values(spark):
    assert run(spark, "xya", "a")["ndcg@10"] == pytest.approx(0.5)
    assert run(spark, "axby", "ab")["ndcg@10"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    assert run(spark, "ax", ["a", "m1", "m2"])["ndcg@10"] == pytest.approx(1 / (1 + 1 / math.log2(3) + 0.5))
    m = run(spark, "axbyz", "abcd")
    assert (m["precision@10"], m["recall@10"], m["hit_rate@10"]) == (0.2, 0.5, 1.0)
    assert run(spark, "xyz", "a")["hit_rate@30"] == 0.0


def test_order_ties_and_failures(spark):
    rows = [("u", "a", 0, 0.5), ("u", "b", 1, 0.9), ("u", "c", 2, 0.5), ("u", "d", 3, float("nan")), ("u", "e", 4, None), ("u", "f", 5, -1e300)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, l1_rank int, score double")
    assert [r.item_id for r in metrics.ranked(df).orderBy("new_rank").collect()] == list("bacfde")


def graded(spark, ranked, labels):
    scores = spark.createDataFrame([(1, x, i, -float(i)) for i, x in enumerate(ranked)], "query_id int, product_id string, l1_rank int, score double")
    q = spark.createDataFrame([(1, p, c, {"E": 1.0, "S": 0.1, "C": 0.01, "I": 0.0}[c]) for p, c in labels.items()], "query_id int, product_id string, label string, gain double")
    return metrics.graded_metrics(scores, q).first().asDict()


def test_graded_golden_values(spark):
    labels = dict(a="E", b="S", c="I", d="E", e="C")
    m = graded(spark, "axbdy", labels)
    assert (m["p@5"], m["p@5_es"], m["p@10"]) == (0.4, 0.6, 0.2)
    m = graded(spark, "xyazdc", labels)
    assert (m["p@5_judged"], m["judged@10"]) == (0.4, 0.3)
    ideal = 1 + 1 / math.log2(3) + 0.1 / 2 + 0.01 / math.log2(5)
    got = (1 / 2 + 1 / math.log2(6))
    assert m["ndcg@10"] == pytest.approx(got / ideal)
    assert graded(spark, "x", {"a": "I"})["ndcg@10"] == graded(spark, "x", {"a": "I"})["recall@100"] == 0.0


def test_positives_are_required(spark):
    users = spark.createDataFrame([("u",)], "user_id string")
    with pytest.raises(ValueError):
        metrics.check_positives(users, spark.createDataFrame([], "user_id string, item_id string"))


def scores(spark, rows):
    return spark.createDataFrame([("u", i, r, s) for i, r, s in rows], "user_id string, item_id string, l1_rank int, score double")


def test_rrf_endpoints_and_tuning(spark):
    a = scores(spark, [("a", 0, 0.1), ("b", 1, 0.9), ("c", 2, 0.5), ("d", 3, None)])
    b = scores(spark, [("a", 0, 4.0), ("b", 1, 3.0), ("c", 2, 2.0), ("d", 3, 1.0)])
    order = lambda df: [r.item_id for r in metrics.ranked(df).orderBy("new_rank").collect()]
    assert order(fusion.fuse_scores(a, b, 1.0)) == list("bcad")
    assert order(fusion.fuse_scores(a, b, 0.0)) == list("abcd")
    pos = spark.createDataFrame([("u", "a")], "user_id string, item_id string")
    same = fusion.tune(b, b, pos).where("chosen").collect()
    assert [r.w for r in same] == [0.0]  # of equal weights the smaller
    assert fusion.tune(b, a, pos).where("chosen").first().w > 0
    w, fused, per = fusion.fuse_run((b, a), (b, a), pos, pos)
    assert w > 0 and fused.count() == 4 and per.count() == 1
    with pytest.raises(ValueError):
        fusion.check_cover(a, b.where("item_id <> 'd'"))


def test_holm(spark):
    def holm(*p):
        df = spark.createDataFrame([(f"m{i}", x) for i, x in enumerate(p)], "model string, p double")
        return [r.p_holm for r in stats.holm(df).orderBy("model").collect()]

    assert holm(0.01, 0.04, 0.03) == pytest.approx([0.03, 0.06, 0.06])
    assert holm(0.6, 0.7) == [1.0, 1.0]


def test_bootstrap_tells_a_win_from_noise(spark):
    rows = [("win", u, 0.2 + (u % 5) / 100) for u in range(60)] + [("noise", u, (-1) ** u * 0.1) for u in range(60)]
    got = {r.model: r for r in stats.compare_to_baseline(spark.createDataFrame(rows, "model string, user_id long, diff double"), 400).collect()}
    assert got["win"].significant and got["win"].ci_low > 0.19
    assert not got["noise"].significant and got["noise"].ci_low < 0 < got["noise"].ci_high
    numbers = sorted(r.i for r in stats.numbered(spark.range(500).select(F.col("id").alias("user_id"))).collect())
    assert numbers == list(range(500))


def test_bootstrap_of_full_size_equals_brute_force(spark):
    draw = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    diffs = {u: (-1) ** u * u / 7 + 0.2 for u in range(9)}
    order = sorted(diffs, key=lambda u: (draw("n", u) % 256, u))
    got = stats.paired_bootstrap(spark.createDataFrame([("m", u, d) for u, d in diffs.items()], "model string, user_id long, diff double")).collect()
    want = {b: sum(diffs[order[draw(0, b, k) % 9]] for k in range(9)) / 9 for b in range(10_000)}
    assert len(got) == 10_000 and all(r.mean == pytest.approx(want[r.b], abs=1e-9) for r in got)


def test_both_ways_of_the_bootstrap_agree(spark, monkeypatch):
    diffs = spark.createDataFrame([(m, u, (u * 7 % 5 - 2) / 3 + k) for k, m in enumerate("mn") for u in range(40)], "model string, user_id long, diff double")
    rows = lambda: sorted(map(tuple, stats.paired_bootstrap(diffs, 300).collect()))
    broadcast = rows()
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 0)
    assert rows() == broadcast and len(broadcast) == 600


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the provided tables")
def test_queries_take_every_resample(spark):
    got = plans.QUERIES["paired_bootstrap"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.b for r in got) == list(range(10_000))


def test_quantiles_are_linear(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 10.0], q) for q in (0.0, 0.5, 0.9, 1.0)], "v array<double>, q double")
    assert [r.x for r in df.select(stats.quantile_of("v", F.col("q")).alias("x"), "q").orderBy("q").collect()] == pytest.approx([0, 1.5, 7.6, 10])
