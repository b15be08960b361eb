"""Scorers under one contract, and the runner that turns scores into metrics."""

from __future__ import annotations

import json
import math
import random
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..storage import stored
from .metrics import per_user_metrics


class ContractError(ValueError):
    """A scorer's answer breaks the contract."""


class RetryableError(RuntimeError):
    """A request that may be sent again."""


def _scores(pool: DataFrame, score: Column) -> DataFrame:
    return pool.select("user_id", "item_id", F.col("rank").alias("l1_rank"), score.cast("double").alias("score"))


def l1_order(pool: DataFrame) -> DataFrame:
    """Minus the rank: the retrieval order itself."""
    return _scores(pool, -F.col("rank"))


def random_order(pool: DataFrame, seed: int = 0) -> DataFrame:
    """A draw in [0, 1) for each (seed, user, item)."""
    return _scores(pool, draw(F.lit(seed), F.col("user_id"), F.col("item_id")) / F.lit(4294967296.0))


def popularity_order(pool: DataFrame, counts: DataFrame) -> DataFrame:
    """Windowed counts of (query_time, item_id, score); an item without a row scores 0."""
    joined = pool.join(counts.select("query_time", "item_id", F.col("score").alias("n")), ["query_time", "item_id"], "left")
    return _scores(joined, F.coalesce("n", F.lit(0.0)))


def oracle_order(pool: DataFrame, positives: DataFrame) -> DataFrame:
    """1 for positives, 0 for the rest."""
    return _scores(pool.join(positives.withColumn("hit", F.lit(1.0)), ["user_id", "item_id"], "left"), F.coalesce("hit", F.lit(0.0)))


def graded_oracle(pool: DataFrame, qrels: DataFrame) -> DataFrame:
    """The gain of a judged product, 0 of others: (query_id, product_id, l1_rank, score)."""
    joined = pool.join(qrels.select("query_id", "product_id", "gain"), ["query_id", "product_id"], "left")
    return joined.select("query_id", "product_id", F.col("rank").alias("l1_rank"), F.coalesce("gain", F.lit(0.0)).alias("score"))


def contract_violations(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """One row of counts: candidates without a score row, rows beyond the candidates, infinite scores, failures (NaN or null)."""
    pair = ["user_id", "item_id"]
    missing = pool.select(pair).exceptAll(scores.select(pair)).agg(F.count("*").alias("missing"))
    extra = scores.select(pair).exceptAll(pool.select(pair)).agg(F.count("*").alias("extra"))
    kinds = scores.agg(F.count_if(F.abs("score") == float("inf")).alias("infinite"), F.count_if(F.isnan("score") | F.col("score").isNull()).alias("failures"))
    return missing.crossJoin(extra).crossJoin(kinds)


class Answer(list):
    """A scorer's scores in the candidates' order, and what its calls went through."""

    def __init__(self, scores: Iterable[float], failures: int = 0, retries: int = 0, waited: float = 0.0, versions: Iterable[str] = (), errors: dict[str, int] | None = None, over_length: int = 0):
        super().__init__(scores)
        self.failures, self.retries, self.waited, self.versions, self.errors, self.over_length = failures, retries, waited, sorted(set(versions)), errors or {}, over_length


def checked(found: list[float], given: int) -> Answer:
    """The answer, if it keeps the contract: as many floats as candidates, none infinite, no NaN beyond the failures it admits."""
    answer = found if isinstance(found, Answer) else Answer(found)
    if not given:
        raise ContractError("nothing to score: the list of candidates is empty")
    if len(answer) != given:
        raise ContractError(f"{len(answer)} scores for {given} candidates")
    if any(not isinstance(x, float) or x in (float("inf"), float("-inf")) for x in answer):
        raise ContractError("scores must be finite floats or NaN")
    if (n := sum(x != x for x in answer)) > answer.failures:
        raise ContractError(f"{n} scores are NaN, but the scorer admits {answer.failures} failures")
    return answer


_CALLS = "latency_s double, failures long, retries long, waited_s double, over_length long, versions string, errors map<string,long>"


def apply_scorer(pool: DataFrame, score: Callable[[dict, list[dict]], list[float]], columns: list[str]) -> DataFrame:
    """Any Python scorer, a user at a time: (user_id, item_id, l1_rank, score) and the user's calls on each row.

    score(user, candidates) gets the candidates in rank order, as dicts of columns, and gives one float for
    each in that order, as an Answer if there is more to tell; `checked` holds it to the contract. Of the
    calls: latency_s, failures, retries, waited_s, over_length, versions (joined by commas) and errors (text
    to count). A user's candidates are a list of bounded length, so the group is too.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        given = rows.to_dict("records")
        began = time.perf_counter()
        found = checked(score({"user_id": given[0]["user_id"]}, given), len(given))
        took, n = time.perf_counter() - began, len(given)
        return pd.DataFrame({
            "user_id": rows.user_id, "item_id": rows.item_id, "l1_rank": rows["rank"], "score": list(found), "latency_s": took, "failures": found.failures, "retries": found.retries,
            "waited_s": found.waited, "over_length": found.over_length, "versions": ",".join(found.versions), "errors": [found.errors] * n,
        })

    kinds = dict(pool.dtypes)
    return pool.select("user_id", "item_id", "rank", *columns).groupBy("user_id").applyInPandas(run, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, l1_rank {kinds['rank']}, score double, {_CALLS}")


def calls(scored: DataFrame) -> DataFrame:
    """(user_id, latency_s, failures, retries, waited_s, over_length, versions, errors): a row for each user of apply_scorer's."""
    names = [c.split()[0] for c in _CALLS.split(", ")]
    return scored.groupBy("user_id").agg(F.min(F.struct("l1_rank", F.struct(*[c for c in names if c != "errors"]).alias("c")))["c"].alias("c"), F.first("errors").alias("errors")).select("user_id", "c.*", "errors")


def run_scorer(pool: DataFrame, score: Callable[[dict, list[dict]], list[float]], columns: list[str], positives: DataFrame, metric: Callable[[DataFrame, DataFrame], DataFrame] = per_user_metrics) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass of a scorer: (scores, a row for each user with metrics and calls, one row of the run's totals).

    metric(scores, positives) gives the users' metrics; another one may replace the binary ones. Failed
    candidates rank last, in retrieval order.
    """
    scored = stored(apply_scorer(pool, score, columns))
    each = calls(scored)
    per_user = metric(scored.select("user_id", "item_id", "l1_rank", "score"), positives).join(each.drop("errors"), "user_id")
    every_version = F.array_distinct(F.flatten(F.collect_set(F.filter(F.split("versions", ","), lambda v: v != ""))))
    totals = each.agg(F.count("*").alias("users"), F.sum("failures").alias("failures"), F.sum("retries").alias("retries"), F.sum("waited_s").alias("waited_s"), F.array_join(F.array_sort(every_version), ",").alias("versions"))
    return scored, per_user, totals


def with_retries(ask: Callable[[], object], most: int = 5, base: float = 0.5, cap: float = 30.0, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> tuple[object, int, float]:
    """(answer, retries, seconds waited): full-jitter backoff on RetryableError only, at most `most` retries."""
    rng, waited = rng or random.Random(), 0.0
    for attempt in range(most + 1):
        try:
            return ask(), attempt, waited
        except RetryableError:
            if attempt == most:
                raise
            wait = rng.uniform(0, min(cap, base * 2**attempt))
            waited += wait
            sleep(wait)
    raise AssertionError("unreachable")


#: Most questions of one request.
MOST_QUESTIONS = 64


def check_status(status: int, body: object = None) -> None:
    """Pass 200; overload and server errors may be tried again, anything else is final."""
    if status in (429, 529) or status >= 500:
        raise RetryableError(f"status {status}")
    if status != 200:
        raise RuntimeError(f"status {status}: {body}")


def pinned(version: str) -> str:
    """A model version that names one model; an alias of whatever is latest is refused."""
    if version.endswith("latest"):
        raise ValueError(f"{version} is an alias; pin a version")
    return version


def decision_scorer(backend: Callable[[dict, list[dict]], object], questions: int = MOST_QUESTIONS, concurrency: int = 8, shuffle_seed: int | None = None, **retry: object) -> Callable[[dict, list[dict]], list[float]]:
    """A scorer that asks a decision backend about at most `questions` candidates a request, several at once.

    backend(user, chunk) gives the probabilities, or (probabilities, version). A request that fails for good
    makes its candidates NaN; failures, retries of answered requests, waits, versions and error texts (300
    characters at most) are told in the Answer. shuffle_seed asks in another order, to see whether order matters.
    """
    if not 0 < questions <= MOST_QUESTIONS:
        raise ValueError(f"1 to {MOST_QUESTIONS} questions a request")

    def ask(user: dict, chunk: list[dict]) -> tuple[list[float], int, float, str | None, str | None]:
        waits: list[float] = []
        sleep = retry.get("sleep", time.sleep)
        try:
            found, retries, _ = with_retries(lambda: backend(user, chunk), **{**retry, "sleep": lambda s: (waits.append(s), sleep(s))})
            probabilities, version = found if isinstance(found, tuple) else (found, None)
            if len(probabilities) != len(chunk):
                raise ContractError("the backend answered another number of questions")
            return [float(x) for x in probabilities], retries, sum(waits), version, None
        except Exception as e:  # any failure is this chunk's alone
            return [float("nan")] * len(chunk), 0, sum(waits), None, f"{type(e).__name__}: {str(e)[:300]}"

    def score(user: dict, candidates: list[dict]) -> list[float]:
        order = list(range(len(candidates)))
        if shuffle_seed is not None:
            random.Random(shuffle_seed).shuffle(order)
        parts = [order[i : i + questions] for i in range(0, len(order), questions)]
        with ThreadPoolExecutor(concurrency) as pool:
            found = list(pool.map(lambda p: ask(user, [candidates[i] for i in p]), parts))
        out, errors = [float("nan")] * len(candidates), Counter(e for *_, e in found if e)
        for part, (scores, *_) in zip(parts, found, strict=True):
            for i, x in zip(part, scores, strict=True):
                out[i] = x
        return Answer(out, sum(x != x for x in out), sum(r for _, r, *_ in found), sum(f[2] for f in found), [f[3] for f in found if f[3]], dict(errors))

    return score


#: Backends that a decision scorer can be made with, by name; each is made from its settings.
BACKENDS: dict[str, Callable[..., Callable[[dict, list[dict]], object]]] = {}


def make_backend(name: str, **settings: object) -> Callable[[dict, list[dict]], object]:
    """The named backend. One that is not registered answers no question: it fails loudly when it is asked, not with a score."""
    if name in BACKENDS:
        return BACKENDS[name](**settings)

    def absent(user: dict, chunk: list[dict]) -> object:
        raise NotImplementedError(f"no backend {name!r} is registered here")

    return absent


def http_backend(send: Callable[[dict], tuple[int, str]], state: Callable[[dict, list[dict]], str], version: str, question: str = "Would this shopper buy candidate {item_id}?") -> Callable[[dict, list[dict]], object]:
    """A backend over a transport: send(request) gives (status, body). Tokens used are on the function's `tokens`.

    The reply holds answers q0, q1, ... as text.parse_reply reads them, the model's version and its usage.
    """

    def ask(user: dict, chunk: list[dict]) -> object:
        request = {"model": pinned(version), "state": state(user, chunk), "questions": {f"q{i}": question.format(**c) for i, c in enumerate(chunk)}}
        status, body = send(request)
        check_status(status, body)
        reply = json.loads(body)
        reply = reply.get("result", reply)
        answers = [reply["answers"][f"q{i}"] for i in range(len(chunk))]
        ask.tokens += (reply.get("usage") or {}).get("input_tokens", 0)
        return [float(a["noul"] if "noul" in a else a["probability"]) for a in answers], reply.get("model")

    ask.tokens = 0
    return ask


def encode_texts(rows: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(id, v) by an encoder that each task makes once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "v": list(encode(b[text_col].fillna("").tolist()))})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(rows.dtypes)[id_col]}, v array<double>")


def run_scores(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs in one table with the model's name."""
    out = None
    for name, df in runs.items():
        one = df.select(F.lit(name).alias("model"), "user_id", "item_id", "l1_rank", "score")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """(model, user_id, metrics) of a table of runs."""
    return per_user_metrics(scores, positives, "model", "user_id")


def run_totals(runs: DataFrame) -> DataFrame:
    """(model, failures, retries, versions): sums, and distinct versions in order joined by commas."""
    return runs.groupBy("model").agg(F.sum("failures").alias("failures"), F.sum("retries").alias("retries"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))


def error_histogram(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error").agg(F.count("*").alias("n"))


def pairwise_scorer(predict: Callable[[list[tuple[str, str]]], list[float]], profile: str = "profile", text: str = "text", batch: int = 32, squash: bool = True, most_tokens: int | None = None, count: Callable[[str], int] = lambda t: len(t.split())) -> Callable[[dict, list[dict]], list[float]]:
    """A cross-encoder as a scorer: (profile, candidate text) pairs in batches; logits become probabilities.

    Pairs of more than most_tokens (by `count`) are scored as they are, and counted.
    """

    def score(user: dict, candidates: list[dict]) -> list[float]:
        pairs = [(c[profile] or "", c[text] or "") for c in candidates]
        found = [float(x) for i in range(0, len(pairs), batch) for x in predict(pairs[i : i + batch])]
        over = sum(count(a) + count(b) > most_tokens for a, b in pairs) if most_tokens else 0
        return Answer([1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x)) for x in found] if squash else found, over_length=over)

    return score


def yes_probability(yes: float, no: float) -> float:
    """The softmax over two logits, of the first."""
    return 1 / (1 + math.exp(min(700.0, no - yes)))


def listwise_scorer(ask: Callable[[dict, list[str]], list[dict]], text: str = "text") -> Callable[[dict, list[dict]], list[float]]:
    """A model that is asked once about all candidates and replies with {'index' or 'text', 'score'} in any order.

    Replies are mapped back by index, else by text (the first candidate of that text that has none); a candidate
    without a reply is a failure.
    """

    def score(user: dict, candidates: list[dict]) -> list[float]:
        texts = [c[text] or "" for c in candidates]
        out = [float("nan")] * len(texts)
        for reply in ask(user, texts):
            at = reply.get("index")
            if at is None:
                at = next((i for i, t in enumerate(texts) if t == reply.get("text") and math.isnan(out[i])), None)
            if at is not None and 0 <= at < len(out):
                out[at] = float(reply["score"])
        return Answer(out, sum(x != x for x in out))

    return score


#: Built-in scorers by name: what each needs besides the pool.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"l1_order": l1_order, "random": random_order, "popularity": popularity_order, "oracle": oracle_order}


#: Model scorers by name: each is made from its settings.
MODELS: dict[str, Callable[..., Callable[[dict, list[dict]], list[float]]]] = {"decision": decision_scorer, "pairwise": pairwise_scorer, "listwise": listwise_scorer}


def build(name: str, **needs: object) -> Callable[[DataFrame], DataFrame]:
    """The scorer of a name, ready for a pool; model scorers take `columns` besides their settings. An unknown name raises."""
    if name in MODELS:
        columns = needs.pop("columns", [])
        return lambda pool: apply_scorer(pool, MODELS[name](**needs), columns)
    if name not in REGISTRY:
        raise ValueError(f"unknown scorer: {name}")
    return lambda pool: REGISTRY[name](pool, **needs)


def with_overrides(settings: dict, overrides: list[str]) -> dict:
    """settings with 'key=value' overrides, values as JSON where they are, else text; a key that settings lack raises."""
    out = dict(settings)
    for item in overrides:
        key, _, value = item.partition("=")
        if key not in out:
            raise ValueError(f"no setting {key!r}")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def first_users(rows: DataFrame, n: int | None) -> DataFrame:
    """Rows of the first n users by id (a smoke test's limit); all without n."""
    if not n:
        return rows
    return rows.join(F.broadcast(rows.select("user_id").distinct().orderBy("user_id").limit(n)), "user_id", "left_semi")
