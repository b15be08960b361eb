import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rankloom.llm import quality_rules as q

from . import cases


def slow(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(spark):
    rnd = random.Random(4)
    say = lambda n: "".join(rnd.choice(["a ", "b ", "c\n", "a b a b\n", "é", " | ", "\t", "##", "\x0b", " ", "X"]) for _ in range(n))
    rows = [*cases.ROWS, *[(100 + k, say(rnd.randint(0, 80)), "en", "a", 1) for k in range(60)], (99, "same line here\n" * 300, "en", "a", 1)]
    got = q.text_measures(cases.docs(spark, rows)).collect()
    assert sorted(((r.doc_id, *[r[c] for c in COUNTS]) for r in got), key=str) == sorted(((r[0], *slow(r[1])) for r in rows), key=str)


def test_rules_on_awkward_rows(spark):
    docs = cases.docs(spark)
    out = q.quality_rules(docs, cases.labels(spark)).collect()
    assert len(out) == len(cases.ROWS)
    for r in out:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed)  # without labels there are no cutoffs
    kept = q.kept(docs, cases.labels(spark))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in out if r.kept), key=str)
    assert q.quality_rules(cases.docs(spark, []), cases.labels(spark)).collect() == []


def test_binomial_bound_is_exact():
    for n, k, p in ((10, 0, 0.3), (40, 7, 0.1), (300, 4, 0.01), (5, 5, 0.2)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(q.binomial_cdf(k, n, p) - want) < 1e-12
    assert q.binomial_cdf(0, 200_000, 0.01) == 0.0 or q.binomial_cdf(0, 200_000, 0.01) < 1e-300


def test_binomial_bound_in_sql(spark):
    rows = [(0, 1), (0, 600), (5, 600), (7, 40), (40, 40), (2, 100_000), (900, 100_000)]
    got = spark.createDataFrame(rows, "x long, n long").selectExpr("x", "n", f"{q.binomial_sql('x', 'n', 0.01)} as p").collect()
    assert all(abs(r.p - q.binomial_cdf(r.x, r.n, 0.01)) < 1e-9 for r in got)


def slow_cutoffs(rows, alpha, delta):
    """The selection of learn_cutoffs, plainly."""
    strata = sorted({r.stratum for r in rows if r.fit and r.good})
    out = {}
    for s in strata:
        good = [r["values"] for r in rows if r.stratum == s and r.fit and r.good]
        junk = [r["values"] for r in rows if r.stratum == s and r.fit and not r.good]
        held = [r["values"] for r in rows if r.stratum == s and not r.fit and r.good]
        path = []
        for j in range(len(q.MEASURES)):
            column = sorted(v[j] for v in good)
            cuts = [column[math.ceil((1 - x) * len(column)) - 1] for x in q.LEVELS]
            caught = [sum(v[j] > c for v in junk) for c in cuts]
            k = next(k for k, x in enumerate(caught) if x >= 0.99 * caught[-1])
            if caught[k]:
                path.append((-caught[k], j, cuts[k]))
        cuts, certified, lost = [None] * len(q.MEASURES), 0, 0
        for k, (_, j, c) in enumerate(sorted(path)):
            x = sum(any(v[a] > b for _, a, b in sorted(path)[: k + 1]) for v in held)
            if x > alpha * len(held) or q.binomial_cdf(x, len(held), alpha) > delta / len(strata):
                break
            cuts[j], certified, lost = c, k + 1, x
        out[s] = (cuts, certified, len(held), lost)
    return out


def test_selection_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for s, n in (("a", 3000), ("b", 3000), ("c", 300), ("", 1200)):
        for i in range(n):
            bad = rnd.random() < 0.2
            v = [rnd.random() ** 4, rnd.random() ** 9, float(rnd.random() < 0.002), 0.0, rnd.gauss(5, 1)]
            if bad and s != "b":
                j = rnd.choice([0, 1, 2])
                v[j] = 1 + rnd.random()
            if bad and s == "b" and i % 3:
                v[4] += 9
            rows.append((s, i, not bad, v, i % 2 == 0))
    df = spark.createDataFrame(rows, "stratum string, sketch long, good boolean, values array<double>, fit boolean").cache()
    for alpha, delta in ((0.01, 0.05), (0.03, 0.1)):
        want = slow_cutoffs(df.collect(), alpha, delta)
        got = {r.stratum: (r.cuts, r.certified, r.n_good, r.rejected) for r in q.learn_cutoffs(df, alpha, delta).collect()}
        assert got == want
        assert want["a"][1] > 0 and want["c"][1] == 0 or alpha > 0.01


def test_copies_are_one_trial(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, text(i // 10 if i < 50 else i), "en", "s", 1) for i in range(80)]
    docs = cases.docs(spark, rows)
    got = q.trials(q.text_measures(docs), cases.labels(spark, [(i, int(i != 3), 0) for i in range(80)])).collect()
    assert len(got) == 35 and sum(not r.good for r in got) == 1


def test_cutoffs_reject_junk_and_spare_good(spark):
    good = F.concat_ws(" ", *[F.concat(F.lit("word"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000))) for k in range(30)])
    junk = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000)), F.lit("$$$")) for k in range(30)])
    base = spark.range(6000).withColumn("bad", F.col("id") % 10 == 0)
    docs = base.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), junk).otherwise(good).alias("text"), F.when(F.col("id") % 50 == 49, "xx").otherwise("en").alias("lang"), "bad")
    labels = base.where("id % 2 = 0 or id % 3 = 0").select(F.col("id").alias("doc_id"), (~F.col("bad")).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    out = q.quality_rules(docs, labels).join(docs.select("doc_id", "bad"), "doc_id")
    row = out.where("lang = 'en'").agg(F.avg(F.when(F.col("bad"), F.col("kept").cast("int"))).alias("junk"), F.avg(F.when(~F.col("bad"), F.col("kept").cast("int"))).alias("good")).first()
    assert row.junk < 0.01 and row.good > 0.98
    assert out.where("lang = 'xx' and not kept").count() == 0  # too few labels: no cutoff is safe


def test_native(spark):
    for df in (q.op1_rows(cases.docs(spark), cases.labels(spark)), q.kept(cases.docs(spark), cases.labels(spark))):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
