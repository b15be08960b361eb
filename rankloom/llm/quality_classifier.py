"""Quality by co-training: a text view and a metadata view teach each other confident pseudo-labels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, gram_hashes, mix, runs, span_hashes
from .langid import fold

#: Labelled rows that the views are trained on, at about most (a documented bound; unlabelled rows have none).
LABELLED = 6_000
#: Places for hashed words and pairs of words, for trigrams of character classes, and shape numbers of the text view; places of the metadata view.
WORD_DIMS, CLASS_DIMS, SHAPES, META_DIMS = 256, 512, 8, 256
TEXT_DIMS = WORD_DIMS + CLASS_DIMS + SHAPES
#: Rounds, and pseudo-labels that a view gives in a round, shared out to the classes as they are in the labels.
ROUNDS, TAUGHT = 3, 300
#: A view teaches a class down to the rank at which, on validation rows, the one-sided 95 % lower bound of its precision is so much.
TRUSTED, BOUND = 0.93, 0.05


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the whole texts of a block.

    Words and pairs of neighbouring words, lower-cased in A-Z, hashed, as root of their share; trigrams of
    character classes likewise; and the shape: shares of words and pairs that occur before, of symbols,
    upper-case letters and digits, words' mean length, and logarithms of the numbers of words and lines.
    """
    rows, sizes = len(offsets) - 1, np.maximum(1, np.diff(offsets))
    out = np.zeros((rows, TEXT_DIMS), np.float32)
    if not len(data):
        return out
    kind = np.full(256, 6, np.uint64)  # other punctuation
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b"#*$%&|<>")):
        kind[list(chars)] = k
    kind[list(b".,;:")], kind[list(b"!?")], kind[0x80:] = 7, 8, 9
    k = kind[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    one, two = (np.append(k[j:], np.full(min(j, len(k)), 10, np.uint64)) for j in (1, 2))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the text's end
    one[left < 2], two[left < 3] = 10, 10  # nothing of the next text
    place = (mix(k * np.uint64(121) + one * np.uint64(11) + two) % np.uint64(CLASS_DIMS)).astype(np.int64)
    counts = np.bincount(row * CLASS_DIMS + place, minlength=rows * CLASS_DIMS).reshape(rows, CLASS_DIMS)
    out[:, WORD_DIMS : WORD_DIMS + CLASS_DIMS] = np.sqrt(counts / sizes[:, None])
    starts, ends = runs((k != 3) & (k != 4) & (data != 11) & (data != 12), offsets)
    low = data + (32 * ((data >= 65) & (data <= 90))).astype(np.uint8)
    word = span_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    of = np.repeat(np.arange(rows), n_words)
    pair = gram_hashes(word, 2)
    pair_of = of[:-1][of[:-1] == of[1:]] if len(of) > 1 else of[:0]
    pair = pair[of[:-1] == of[1:]] if len(of) > 1 else pair
    both, both_of = np.concatenate([word, pair]), np.concatenate([of, pair_of])
    counts = np.bincount(both_of * WORD_DIMS + (both % np.uint64(WORD_DIMS)).astype(np.int64), minlength=rows * WORD_DIMS).reshape(rows, WORD_DIMS)
    out[:, :WORD_DIMS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1))[:, None])

    def again(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The share of a row's values that the row has had before."""
        key = np.unique(mix(values ^ mix(owner.astype(np.uint64))), return_index=True)[1]
        n = np.bincount(owner, minlength=rows)
        return 1 - np.bincount(owner[key], minlength=rows) / np.maximum(1, n)

    share = lambda classes: np.bincount(row, np.isin(k, classes), rows) / sizes
    lines = np.bincount(row, data == 10, rows)
    length = np.bincount(of, ends - starts, rows) / np.maximum(1, n_words)
    out[:, WORD_DIMS + CLASS_DIMS :] = np.stack([again(word, of), again(pair, pair_of), share([5]), share([1]), share([2]), np.minimum(4, length / 8), np.log2(1 + n_words) / 10, np.log2(1 + lines) / 10], axis=1)
    return out


def meta_view(lang: list, source: list, chars: np.ndarray) -> np.ndarray:
    """Features of the metadata alone: language, source, the length's place on a log scale, and their crosses, hashed."""
    out = np.zeros((len(lang), META_DIMS), np.float32)
    size = (6 * np.log2(1 + np.maximum(0, chars))).astype(int).tolist()
    for r, (a, b, c) in enumerate(zip(lang, source, size, strict=True)):
        for value in (f"l{a}", f"s{b}", f"n{c}", f"n{c // 6}l{a}", f"l{a}s{b}"):
            out[r, hash_text(value) % META_DIMS] += 1
    return out


def hash_text(text: str) -> int:
    h = 1469598103934665603
    for b in text.encode():
        h = (h ^ b) * 1099511628211 & 0x7FFFFFFFFFFFFFFF
    return h


@dataclass
class Linear:
    """A logistic model with Platt's calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Linear:
    """Logistic regression by Newton steps with a ridge, classes weighted evenly; deterministic."""
    n, d = x.shape
    share = max(1e-6, min(1 - 1e-6, float(y.mean()) if n else 0.5))
    sample = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    z = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    w = np.zeros(d + 1)
    penalty = np.full(d + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = sample * np.maximum(1e-4, p * (1 - p))
        change = np.linalg.solve((z * v[:, None]).T @ z + np.diag(penalty), z.T @ (sample * (p - y)) + penalty * w)
        w -= change
        if np.abs(change).max() < 1e-4:
            break
    return Linear(w[:-1], float(w[-1]))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift so that margins on labelled rows become probabilities of their true base rate."""
    if len(y) < 10 or y.min() == y.max():
        return
    one = fit_1d(model.margin(x), y)
    model.slope, model.shift = one


def fit_1d(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(1e-6, p * (1 - p))
        h = np.array([[np.sum(v * m * m) + 0.1, np.sum(v * m)], [np.sum(v * m), np.sum(v) + 0.1]])
        g = np.array([np.sum((p - y) * m) + 0.1 * (a - 1), np.sum(p - y) + 0.1 * b])
        change = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - change[0], b - change[1]
    return float(max(a, 0.0)), float(b)


def auc(p: np.ndarray, y: np.ndarray) -> float:
    """The chance that a good row scores above a bad one, ties half; 0.5 with rows of one kind."""
    good = float(y.sum())
    if not 0 < good < len(y):
        return 0.5
    _, inverse, n = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return float((rank[y > 0].sum() - good * (good + 1) / 2) / (good * (len(y) - good)))


def lower_bound(right: int, n: int, chance: float = BOUND) -> float:
    """The exact (Clopper-Pearson) one-sided lower bound of a rate of which `right` of n trials speak."""
    if not right:
        return 0.0
    low, high = 0.0, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(right, n + 1)]
    for _ in range(40):  # the rate at which `right` or more would come with this chance
        p = (low + high) / 2
        tail = math.fsum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for c, i in zip(logs, range(right, n + 1), strict=True))
        low, high = (p, high) if tail < chance else (low, p)
    return low


def trusted_from(p: np.ndarray, y: np.ndarray, trusted: float = TRUSTED) -> float | None:
    """The least score p of the longest leading part of validation rows, by p, whose precision's lower bound is `trusted`; None if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order] > 0)
    for n in range(len(p), 0, -1):
        if right[n - 1] / n >= trusted and (n == len(p) or p[order[n]] < p[order[n - 1]]) and lower_bound(int(right[n - 1]), n) >= trusted:
            return float(p[order[n - 1]])
    return None


def _logit(v: np.ndarray) -> np.ndarray:
    return np.log(np.clip(v, 1e-6, 1 - 1e-6) / np.clip(1 - v, 1e-6, 1))


@dataclass
class CoTrained:
    """Both views, how their calibrated log-odds combine, and a row for each round of what was measured and taught."""

    text: Linear
    meta: Linear
    mix: tuple[float, float, float]  # weight of text, of metadata, shift; a view that does not help has weight 0
    taught: tuple[int, int] = (0, 0)  # pseudo-labels that the text view has learned, and the metadata view
    history: list[dict] = field(default_factory=list)

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = self.text.prob(x), self.meta.prob(m)
        both = self.mix[0] * _logit(p) + self.mix[1] * _logit(q) + self.mix[2]
        return p, q, 1 / (1 + np.exp(-np.clip(both, -30, 30)))


@dataclass
class Offer:
    """What a view may teach in a round: for good (1) and bad (0) the least confidence and the number of rows."""

    models: tuple[Linear, Linear]
    least: dict[tuple[int, int], float]  # (view, class)
    most: dict[int, int]  # by class
    done: tuple[frozenset[int], frozenset[int]]  # texts that a view has taught already


#: A view's pseudo-labels: (view, class, confidence, text's hash, x, m), the most confident first, ties by hash.
Picked = list[tuple[int, int, float, int, np.ndarray, np.ndarray]]


def combination(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of both views' log-odds and a shift: of text alone, metadata alone and both what validates best.

    Each choice is fitted on one half of the validation rows and judged on the other by its log-loss, both
    ways round. A view that does not help gets weight 0.
    """
    if len(y) < 20 or y.min() == y.max():
        return 0.5, 0.5, 0.0
    both = np.column_stack([_logit(p), _logit(q)])

    def fitted(use: list[int], rows: np.ndarray) -> tuple[float, float, float]:
        joint = fit(both[rows][:, use], y[rows], ridge=1.0)
        a, b = fit_1d(joint.margin(both[rows][:, use]), y[rows])
        w = [0.0, 0.0]
        for k, v in zip(use, joint.weights, strict=True):
            w[k] = max(0.0, float(a * v))
        return w[0], w[1], float(a * joint.bias + b)

    half = np.arange(len(y)) % 2 == 0
    loss = []
    for use in ([0], [1], [0, 1]):
        total = 0.0
        for rows in (half, ~half):
            if y[rows].min() == y[rows].max():
                return 0.5, 0.5, 0.0
            w = fitted(use, rows)
            z = np.clip(both[~rows] @ np.array(w[:2]) + w[2], -30, 30)
            total += float(np.sum(np.logaddexp(0, -z) * (y[~rows] > 0) + np.logaddexp(0, z) * (y[~rows] <= 0)))
        loss.append(total)
    return fitted([[0], [1], [0, 1]][int(np.argmin(loss))], np.ones(len(y), bool))


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pick: Callable[[Offer], Picked], rounds: int = ROUNDS, taught: int = TAUGHT) -> CoTrained:
    """Train both views; every third labelled row validates and calibrates.

    In each round a view offers the other those unlabelled texts of whose class it is surest, found by `pick`
    over all of them, `taught` in all, in the labels' proportion. It offers a class only down to the score at
    which validation rows prove its precision (trusted_from): a view that nowhere proves it teaches nothing.
    """
    held = np.arange(len(y)) % 3 == 2
    views, base = (x, m), float(y[~held].mean())
    most = {1: max(1, round(taught * base)), 0: max(1, round(taught * (1 - base)))}
    learned: list[list[tuple[np.ndarray, int]]] = [[], []]  # what each view has been taught
    done: list[set[int]] = [set(), set()]
    history, models = [], [None, None]
    for r in range(rounds + 1):
        for k, own in enumerate(views):
            extra = np.array([v for v, _ in learned[k]], own.dtype).reshape(-1, own.shape[1])
            models[k] = fit(np.vstack([own[~held], extra]), np.concatenate([y[~held], [c for _, c in learned[k]]]))
            calibrate(models[k], own[held], y[held])
        p = [models[k].prob(own[held]) for k, own in enumerate(views)]
        row = {"round": r, "text_learned": len(learned[0]), "meta_learned": len(learned[1])}
        for name, scores in zip(("text", "meta"), p, strict=True):
            bad = y[held] <= 0
            row |= {f"{name}_auc": round(auc(scores, y[held]), 4), f"{name}_bad_recall": round(float(np.mean(scores[bad] < 0.5)), 4) if bad.any() else None}
        history.append(row)
        if r == rounds:
            break
        least = {}
        for k in (0, 1):
            for c in (0, 1):
                at = trusted_from(p[k] if c else 1 - p[k], y[held] if c else 1 - y[held])
                if at is not None:
                    least[k, c] = max(0.5, at)
        found = pick(Offer(tuple(models), least, most, (frozenset(done[0]), frozenset(done[1])))) if least else []
        for k, c, _, text, fx, fm in found:
            learned[1 - k].append(((fx, fm)[1 - k], c))
            done[k].add(text)
        if not found:
            break
    return CoTrained(models[0], models[1], combination(*[models[k].prob(own[held]) for k, own in enumerate(views)], y[held]), (len(learned[0]), len(learned[1])), history)


def best_offers(offer: Offer, x: np.ndarray, m: np.ndarray, texts: list[int]) -> Picked:
    """Of these rows what the offer's views are surest of: for each view and class its most, each text once."""
    out: Picked = []
    for k, own in enumerate((x, m)):
        p = offer.models[k].prob(own)
        for c in (0, 1):
            if (k, c) not in offer.least:
                continue
            sure = np.round(p if c else 1 - p, 9)
            seen: set[int] = set()
            for r in np.lexsort((np.array(texts, np.int64), -sure)).tolist():
                if sure[r] < offer.least[k, c] or len(seen) >= offer.most[c]:
                    break
                if texts[r] not in seen and texts[r] not in offer.done[k]:
                    seen.add(texts[r])
                    out.append((k, c, float(sure[r]), texts[r], x[r], m[r]))
    return out


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, text view and metadata view, a slice of rows at a time (the views are dense); columns lang, source, n_chars, text."""
    lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    given = batch.column("n_chars").to_pylist()
    for at, data, offsets in blocks(batch.column("text"), 1 << 20):
        to = at + len(offsets) - 1
        edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = np.array([g if g is not None else c for g, c in zip(given[at:to], np.diff(edges).tolist(), strict=True)], np.float64)
        for a in range(0, to - at, 512):
            b = min(a + 512, to - at)
            own = offsets[a : b + 1]
            yield at + a, text_view(data[own[0] : own[-1]], own - own[0]), meta_view(lang[at + a : at + b], source[at + a : at + b], n[a:b])


def _frame(docs: DataFrame, id_col: str) -> DataFrame:
    have = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return docs.select(F.col(id_col).alias("doc_id"), have("lang", "string").alias("lang"), have("source", "string").alias("source"), have("n_chars", "long").alias("n_chars"), F.col("text").cast("string").alias("text"))


_OFFERED = "view int, class int, sure double, text long, x binary, m binary"


def picker(rows: DataFrame) -> Callable[[Offer], Picked]:
    """pick for co_train over all rows (as of _frame): each task keeps its best of every view and class, and of these the best are ranked.

    Rows meet in two steps, first within 16 parts of the texts, so that no task reads what all tasks offer.
    The driver gets the offer's number of rows, a few kilobytes each.
    """
    spark = rows.sparkSession

    def pick(offer: Offer) -> Picked:
        shared = spark.sparkContext.broadcast(offer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], dict[int, tuple]] = {}
            for batch in batches:
                texts = batch.column("hash").to_pylist()
                for at, x, m in _views(batch):
                    for row in best_offers(shared.value, x, m, texts[at : at + len(x)]):
                        own = held.setdefault(row[:2], {})
                        own.setdefault(row[3], (*row[:4], row[4].astype(np.float16).tobytes(), row[5].astype(np.float16).tobytes()))
                for (k, c), own in held.items():
                    if len(own) > 2 * shared.value.most[c]:
                        held[k, c] = {r[3]: r for r in sorted(own.values(), key=lambda r: (-r[2], r[3]))[: shared.value.most[c]]}
            found = [r for (_, c), own in sorted(held.items()) for r in sorted(own.values(), key=lambda r: (-r[2], r[3]))[: shared.value.most[c]]]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["view", "class", "sure", "text", "x", "m"])

        top = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(run, _OFFERED).dropDuplicates(["view", "class", "text"]).withColumn("part", F.pmod("text", F.lit(16)))
        wanted = F.when(F.col("class") == 1, offer.most[1]).otherwise(offer.most[0])
        for keys in (["view", "class", "part"], ["view", "class"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sure"), "text"))
            top = top.withColumn("place", place).where(F.col("place") <= max(offer.most.values())).where(F.col("place") <= wanted)
        back = lambda v: np.frombuffer(bytes(v), np.float16).astype(np.float32)
        found = [(r["view"], r["class"], r["sure"], r["text"], back(r["x"]), back(r["m"])) for r in top.collect()]
        return sorted(found, key=lambda r: (r[0], r[1], -r[2], r[3]))

    return pick


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = LABELLED, rounds: int = ROUNDS, taught: int = TAUGHT) -> CoTrained | None:
    """Co-train on about `labelled` labelled rows, chosen by a hash of the id, and on all unlabelled ones, outside the held-out fold.

    Every round scores every unlabelled document by both views. The driver gets the features (1,032 numbers a
    row) of the labelled rows and of the `taught` pseudo-labels that a view gives in a round; both are
    parameters. None if the labels are of one kind only. A doc_id labelled twice is good only if every label
    says so; documents whose labels are left out by the bound count as unlabelled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (fold(id_col, 5) != 0)).groupBy(id_col).agg(F.min("quality").cast("int").alias("quality"))
    n = known.count()
    share = int(min(1.0, labelled / max(1, n)) * (1 << 30))
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64(id_col, F.lit(31)), F.lit(1 << 30)) < share))  # about `labelled` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column("quality").to_pylist()
            for at, x, m in _views(batch):
                yield pa.RecordBatch.from_arrays([pa.array(quality[at : at + len(x)], pa.int32()), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary()), pa.array([v.astype(np.float16).tobytes() for v in m], pa.binary())], names=["quality", "x", "m"])

    found = _frame(docs, id_col).join(chosen.withColumnRenamed(id_col, "doc_id"), "doc_id").drop("doc_id").mapInArrow(run, "quality int, x binary, m binary").collect()
    found.sort(key=lambda r: (bytes(r.x), bytes(r.m), r.quality))  # the same model whatever the partitions
    side = lambda k, d: np.array([np.frombuffer(bytes(r[k]), np.float16) for r in found], np.float32).reshape(-1, d)
    x, m, y = side("x", TEXT_DIMS), side("m", META_DIMS), np.array([r.quality for r in found], float)
    if len(y) < 10 or y.min() == y.max():
        return None
    order = np.random.default_rng(0).permutation(len(y))
    rest = _frame(docs, id_col).where(fold("doc_id", 5) != 0).join(chosen.select(F.col(id_col).alias("doc_id")), "doc_id", "left_anti")
    return co_train(x[order], m[order], y[order], picker(rest), rounds, taught)


def score(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, p_text, p_meta, score) for every row of docs: each view's probability of good quality, and both.

    Null texts are empty texts; null metadata is a value of its own; without a model (labels of one kind
    only) every probability is 0.5. Columns lang, source and n_chars may be missing. Repeated rows stay
    repeated; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, out = shared.value, [np.full(batch.num_rows, 0.5) for _ in range(3)]
            if known is not None:
                for at, x, m in _views(batch):
                    for column, values in zip(out, known.score(x, m), strict=True):
                        column[at : at + len(x)] = values
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], names=["doc_id", "p_text", "p_meta", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _frame(docs, id_col).mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double")


def op4_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's quality, learned outside fold 0 of crc32(doc_id) mod 5."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "p_text", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
