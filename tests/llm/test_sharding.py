import zlib

from pyspark.sql import functions as F

from rankloom.llm import sharding

from . import cases


def check(rows, n_shards, tolerance):
    total, most = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
    for s in range(n_shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n_shards) <= tolerance * total / n_shards + 2 * most


def test_awkward_rows(spark):
    docs = cases.docs(spark)
    out = sharding.shard(docs, 3)
    assert set(docs.columns) <= set(out.columns)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == len(cases.ROWS)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert 0 <= r["shard"] < 3
    for s in range(3):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_empty(spark):
    assert sharding.shard(cases.docs(spark, []), 8).collect() == []


def test_bytes_are_even_with_a_hot_group(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same "), 20)).otherwise(F.concat(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.col("id"))).alias("text"))
    rows = [r.asDict() for r in sharding.shard(df, 8).collect()]
    assert len(rows) == 30_000
    check(rows, 8, 0.002)


def test_splitters_meet_targets_and_stay_in_order(spark):
    keys = spark.createDataFrame([(k, s) for k, s in [(5, 10)] * 50 + [(-(1 << 62), 7)] * 3 + [(i * (1 << 52), i % 9 + 1) for i in range(-900, 900)]], "key long, size long").cache()
    rows = sorted((r.key, r["size"]) for r in keys.collect())
    total = sum(s for _, s in rows)
    targets = [total * k // 8 for k in range(1, 8)]
    found = sharding.splitters(keys, targets, [5] * 7)
    assert found == sorted(found)
    for t, e in zip(targets, found, strict=True):
        assert abs(sum(s for k, s in rows if k < e) - t) <= 250  # the heaviest key has half of 500


def test_forty_thousand_ranges(spark):
    """Splitters against brute force, more of them than the first round has probes."""
    import bisect

    keys = spark.range(120_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 90 + 1).alias("size")).cache()
    rows = sorted((r.key, r["size"]) for r in keys.collect())
    ends, at = [], 0
    for _, size in rows:
        at += size
        ends.append(at)
    targets = [at * k // 40_000 for k in range(1, 40_000)]
    found = sharding.splitters(keys, targets, [13] * len(targets))
    assert found == sorted(found)
    order = [k for k, _ in rows]
    for t, e in zip(targets, found, strict=True):
        i = bisect.bisect_left(order, e)
        assert abs((ends[i - 1] if i else 0) - t) <= 45  # within the slack or half of the heaviest row


def test_equal_texts_stand_together(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("text"))
    rows = sorted((r.shard, r.slot, r.text) for r in sharding.shard(df, 4).collect())
    runs = 1 + sum(a[2] != b[2] for a, b in zip(rows, rows[1:], strict=False))
    assert runs == 300


def test_range_of(spark):
    edges = [-5, -5, 0, 3, 9]
    got = spark.range(-10, 15).select("id", sharding.range_of("id", edges).alias("r")).collect()
    assert all(r.r == sum(e <= r.id for e in edges) for r in got)


def test_native(spark):
    plan = sharding.op10_rows(cases.docs(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
