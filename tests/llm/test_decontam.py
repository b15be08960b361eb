import re

from pyspark.sql import functions as F

from rankloom.llm import decontam

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, k=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for at in range(max(1, len(w) - k + 1) if w else 0):
            win = w[at : at + k]
            for i in range(len(own) - len(win) + 1):
                if own[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def result(df):
    return sorted(((r.doc_id, r.n_words, sum(s.e - s.s for s in r.spans), list(r.items_)) for r in df.withColumnRenamed("items", "items_").collect()), key=str)


ITEMS = [(1, cases.PLAIN.upper() + "!"), (2, "one"), (3, None), (4, ""), (10, "a b a b a b a b a b a b a b"), (11, "the quick, brown"), (None, "lazy dog"), (12, "漢字 😀"), (2, "one")]
DOCS = [*cases.ROWS, (20, "x " + " ".join(["a b"] * 30) + " y", "en", "a", 1), (21, "the quick brown one the quick", "en", "a", 1)]


def test_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(1))
    want = sorted(((r[0], *slow(r[1], [(i if i is not None else "", t) for i, t in ITEMS])) for r in DOCS), key=str)
    docs = cases.docs(spark, DOCS)
    assert result(decontam.benchmark_hits(docs, bench)) == want
    # several passes over a benchmark that is too large for one
    assert result(decontam.benchmark_hits(docs, bench, windows_per_pass=4)) == want
    for per_pass in (10**6, 4):
        kept = decontam.kept(docs, bench, windows_per_pass=per_pass)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_empty(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = bench.where("false")
    assert decontam.benchmark_hits(cases.docs(spark, []), bench).collect() == []
    assert all(not r.spans for r in decontam.benchmark_hits(cases.docs(spark), none).collect())
    assert decontam.kept(cases.docs(spark), none).count() == len(cases.ROWS)


def test_random_overlaps(spark):
    import random

    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("a b c".split()) for _ in range(n))
    items = [(i, say(rnd.choice([3, 9, 10, 12, 20]))) for i in range(6)]
    rows = [(i, say(rnd.randint(0, 120)) + " " + (items[i % 6][1] if i % 3 == 0 else "") + " " + say(5), "en", "a", 1) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], *slow(r[1], items)) for r in rows), key=str)
    assert result(decontam.benchmark_hits(cases.docs(spark, rows), bench)) == want
