"""Quality rules with risk-controlled thresholds: DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored

#: Share of good documents that the learned cutoffs may reject in any stratum, and the chance that one stratum breaks this.
ALPHA, DELTA = 0.01, 0.05
#: Upper-tail shares of good documents whose quantiles are the candidate cutoffs, from lenient to strict.
LEVELS = (0.0002, 0.0005, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.005)
#: Measures of junk, the larger the worse: symbols a word, upper-case letters a word character, share of
#: words in repeated windows, share of repeated lines, characters a word.
MEASURES = ("m_symbols", "m_upper", "m_repeat", "m_lines", "m_length")
#: Base rules (fixed values of the contract).
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5


def _windows(words: str, k: int = REPEAT_WINDOW) -> str:
    """SQL for (n, least) of the array `words`: words in k-word windows that occur twice or more, and the least window hash.

    Windows are compared by 64-bit hashes of word hashes. Only a text with a repeated window sorts its
    windows (n log n, also in a very long text). A text of fewer words is one window for `least`, which
    copies share, and near copies mostly. transform(array(x), v -> ...)[0] names a value once.
    """
    window = ", ".join(f"get(h, i + {j})" for j in range(1, k))
    return f"""if(size({words}) < {k}, named_struct('n', 0L, 'least', xxhash64(array_join({words}, ' '))),
      transform(array(transform({words}, w -> xxhash64(w))), h ->
        transform(array(transform(slice(h, 1, size(h) - {k - 1}), (x, i) -> xxhash64(x, {window}))), g -> named_struct('n',
          if(size(array_distinct(g)) = size(g), 0L,
            transform(array(sort_array(transform(g, (x, i) -> struct(x, i)))), s ->
              transform(array(sort_array(transform(filter(s, (e, j) -> e.x = get(s, j - 1).x or e.x = get(s, j + 1).x), e -> e.i))), p ->
                aggregate(transform(p, (x, j) -> if(j = 0, {k}, least({k}, x - get(p, j - 1)))), 0L, (a, x) -> a + x)
              )[0])[0]), 'least', array_min(g)))[0])[0])"""


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns with the base counts, MEASURES and sketch of each whole text (null: as an empty text).

    sketch is the least hash of a text's windows, which copies and most near copies share. n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words: as the contract of
    the query defines them. A column of docs with one of these names is replaced.
    """
    text = f"coalesce(cast(`{text_col}` as string), '')"
    split = f"array_remove(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"
    counts = f"""transform(array({split}), ws -> named_struct(
        'n_words', cast(size(ws) as bigint),
        'word_chars', cast(char_length(array_join(ws, '')) as bigint),
        'windows', {_windows('ws')}))[0]"""
    lines = f"""transform(array(filter(split({text}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')), ls -> named_struct(
        'n', size(ls), 'repeated', size(ls) - size(array_distinct(ls))))[0]"""
    out = docs.withColumns({
        "_words": F.expr(counts),
        "_lines": F.expr(lines),
        "n_symbols": F.expr(f"cast(regexp_count({text}, '[#*$%&|<>]') as bigint)"),
        "_upper": F.expr(f"regexp_count({text}, '\\\\p{{Lu}}')"),
    })
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n, chars = F.col("_words.n_words"), F.col("_words.word_chars")
    return out.withColumns({
        "n_words": n,
        "word_chars": chars,
        "n_dup_lines": F.col("_lines.repeated").cast("long"),
        "n_repeat_words": F.col("_words.windows.n"),
        "m_symbols": ratio(F.col("n_symbols"), n),
        "m_upper": ratio(F.col("_upper"), chars),
        "m_repeat": ratio(F.col("_words.windows.n"), n),
        "m_lines": ratio(F.col("_lines.repeated"), F.col("_lines.n")),
        "m_length": ratio(chars, n),
        "sketch": F.col("_words.windows.least"),
    }).drop("_words", "_lines", "_upper")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials with chance p, summed exactly (in logarithms, so no n underflows)."""
    if k >= n:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def binomial_sql(k: str, n: str, p: float) -> str:
    """SQL for binomial_cdf: terms from one to the next in logarithms."""
    first, odds = f"{n} * ln(1 - {p!r}D)", f"ln({p!r}D / (1 - {p!r}D))"
    term = f"a.l + ln(({n} - i + 1) / i) + {odds}"
    return f"""case when {k} >= {n} then 1D when {k} < 1 then exp({first}) else aggregate(sequence(1L, {k}),
      named_struct('l', cast({first} as double), 's', exp({first})), (a, i) -> named_struct('l', {term}, 's', a.s + exp({term})), a -> a.s) end"""


def trials(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(stratum, sketch, good, values, fit): one row a trial, half of them to fit on and half to test on.

    A trial is a distinct text of a stratum: labelled documents of one sketch, copies and near copies, count
    once, good only if all of them are, with the measures of the smallest id; so no copy stands on both
    sides, nor counts twice in a bound. Only documents that pass the base rules take part. A null stratum is
    one of its own (''); null ids and labels are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg((F.min("quality") > 0).alias("good"))
    rows = measured.where(~base_failed()).select(id_col, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "sketch", F.array(*MEASURES).alias("values"))
    met = rows.join(known, id_col).groupBy("stratum", "sketch").agg(F.min("good").alias("good"), F.min(F.struct(id_col, "values"))["values"].alias("values"))
    return met.withColumn("fit", F.pmod(F.xxhash64("sketch", F.lit(29)), F.lit(2)) == 0)


def learn_cutoffs(rows: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cuts, certified, n_good, rejected) from trials: the cutoffs of MEASURES that a stratum's labels prove.

    On the fitting half every measure gets a cutoff: of the quantiles of good texts at LEVELS the most
    lenient one that catches 99 % of the junk that the strictest does; measures that catch none get none.
    Measures in the order of the junk they catch make a path of rules, each rejecting what the one before
    does and more. On the testing half the path is walked while the exact binomial bound holds: a false
    rejection rate over alpha would show so few rejected good texts with a chance of delta at most (fixed
    sequence, so the steps need no correction among themselves); delta is shared out evenly over the strata
    (Bonferroni). So with chance 1 - delta no stratum loses more than alpha of its good texts. cuts has a
    number or null for each measure, certified how many are proven, rejected the good texts they reject.

    A row for each stratum with a good fitting text; nothing comes to the driver. Strata with very many rows
    are split (skew_join).
    """
    n, total = len(MEASURES), rows.count()
    at = F.array(*[F.lit(1 - x) for x in LEVELS])
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("weight"))
    quantiles = rows.where("fit and good").groupBy("stratum").agg(F.array(*[F.percentile_approx(F.col("values")[j], at, 10_000) for j in range(n)]).alias("q"))
    fitted = skew_join(rows.where("fit and not good"), sizes.join(quantiles, "stratum", "left"), "stratum", "weight", total).where("q is not null")
    caught = fitted.groupBy("stratum").agg(F.array(*[F.array(*[F.count_if(F.col("values")[j] > F.col("q")[j][k]) for k in range(len(LEVELS))]) for j in range(n)]).alias("caught"))
    path = f"""filter(transform(sequence(0, {n - 1}), j -> transform(array(array_position(transform(caught[j], x -> x >= 0.99 * caught[j][{len(LEVELS) - 1}]), true)),
        k -> named_struct('less', -caught[j][k - 1], 'j', j, 'cut', q[j][cast(k as int) - 1]))[0]), x -> x.less < 0)"""
    paths = quantiles.join(caught, "stratum", "left").join(sizes, "stratum").select("stratum", "weight", F.when(F.col("caught").isNotNull(), F.array_sort(F.expr(path))).alias("path"))
    paths = stored(paths)
    held = skew_join(rows.where("not fit and good"), sizes.join(paths.drop("weight"), "stratum", "left"), "stratum", "weight", total)
    step = F.expr("coalesce(array_position(transform(path, x -> values[x.j] > x.cut), true), 0)")  # the first rule of the path that rejects
    shown = held.withColumn("step", step).groupBy("stratum").agg(F.count("*").alias("n_good"), F.array(*[F.count_if((F.col("step") > 0) & (F.col("step") <= k + 1)) for k in range(n)]).alias("upto"))
    share = paths.agg(F.count("*").alias("strata"))
    tested = paths.join(shown, "stratum", "left").crossJoin(F.broadcast(share))  # one row
    passed = f"x <= {alpha!r}D * n_good and {binomial_sql('x', 'n_good', alpha)} <= {delta!r}D / strata"
    tested = tested.withColumn("ok", F.expr(f"transform(slice(upto, 1, size(path)), x -> {passed})"))
    tested = tested.withColumn("certified", F.expr("case when n_good is null or path is null then 0 when array_contains(ok, false) then cast(array_position(ok, false) as int) - 1 else size(path) end"))
    cuts = f"transform(sequence(0, {n - 1}), j -> get(filter(slice(path, 1, certified), x -> x.j = j), 0).cut)"
    return tested.select("stratum", F.expr(cuts).alias("cuts"), "certified", F.coalesce("n_good", F.lit(0)).alias("n_good"), F.expr("if(certified > 0, upto[certified - 1], 0L)").alias("rejected"))


def apply_rules(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with base_failed, certified and kept: kept unless the base rules or a proven cutoff of the stratum reject.

    Every stratum's row, with cutoffs or without, meets its documents by skew_join, so that documents of
    large strata stay where they are.
    """
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in measured.columns)) + "stratum"  # no column of measured
    keyed = measured.withColumn(own, F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    sizes = keyed.groupBy(own).agg(F.count("*").alias("weight"))
    known = stored(sizes.join(cutoffs.select(F.col("stratum").alias(own), F.col("cuts").alias(f"{own}_cuts"), "certified"), own, "left"))
    out = skew_join(keyed.drop("certified"), known, own, "weight", keyed.count(), "left")
    over = F.coalesce(F.greatest(*[F.coalesce(F.col(m) > F.col(f"{own}_cuts")[j], F.lit(False)) for j, m in enumerate(MEASURES)]), F.lit(False))
    out = out.withColumns({"certified": F.coalesce("certified", F.lit(0)), "base_failed": base_failed(), "kept": ~base_failed() & ~over})
    return out.drop(own, f"{own}_cuts")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row for every row of docs: doc_id, the stratum, base counts, MEASURES, base_failed, certified and kept.

    certified is the number of cutoffs proven for the document's stratum. Null and empty texts have no words
    and fail the base rules. Repeated rows stay repeated; other columns of docs are ignored; empty docs give
    no rows, empty labels no cutoffs. Texts are read once: the measures, a few numbers a document, are
    written to the shared folder for both the cutoffs and the verdict.
    """
    narrow = docs.select(F.col(id_col), F.col(stratum), F.col(text_col))
    measured = stored(text_measures(narrow, text_col).drop(text_col))
    return apply_rules(measured, learn_cutoffs(stored(trials(measured, labels, stratum, id_col)), alpha, delta), stratum)


def kept(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps.

    Rows and their measures are written to the shared folder together: the texts are measured once and
    nothing is joined back.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col), F.col(stratum), F.col(text_col))
    measured = stored(text_measures(whole, text_col).drop(text_col))
    cutoffs = learn_cutoffs(stored(trials(measured, labels, stratum, id_col)), alpha, delta)
    return apply_rules(measured, cutoffs, stratum).where("kept").select("_row.*")


def op1_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query."""
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "certified", "kept")
