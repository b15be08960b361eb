"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context around each match."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, code_points, runs
from .langid import fold

#: Labelled rows that the lexicon and the weights are fitted on, at about most; terms that share one table.
TRAIN_ROWS, TABLE_TERMS = 20_000, 100
#: Labelled texts with a term's one-edit matches from which they are judged for themselves.
FEW = 5
#: The least log-likelihood ratio of a term: chance reaches it once in e**14, about a million, words.
SURE = 14.0
#: A term is at least so long, and so long to be matched with an edit. Words on either side that make a context.
SHORTEST, SHORTEST_FUZZY, CONTEXT = 3, 4, 6
#: Words around a match that tell of speech about abuse, or of speech to someone (fixed values, four languages).
REPORTING = "said says called calling wrote quoted quote word term slur insult dit disait mot terme insulte sagte nannte wort begriff dijo llamó palabra término insulto"
ADDRESSING = "you your youre ur u tu te toi vous votre du dich dein ihr euch usted tú eres vosotros"
PLAIN, QUOTED, DIRECTED = 0, 1, 2
#: Pseudo-counts (toxic, clean) of the contexts before any labelled match is seen.
PRIOR = {PLAIN: (9.0, 1.0), QUOTED: (1.0, 3.0), DIRECTED: (9.0, 0.5)}
_QUOTES = "\"“”„«»‘’'`"
#: Marks that pair with each other; what a mark opens or closes if its neighbours do not tell ('"' does the other of the last).
_FAMILY = {c: k for k, group in enumerate(('"“”„', "«»", "‘’'`")) for c in group}
_OPENS, _CLOSES, _SINGLE = "“„«‘", "”»", 2
_MARK = re.compile(r"[\"“”„«»‘’'`\n]|[.!?](?=\s)")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 2**16: is it part of a word (letter or digit); its lower case."""
    word = np.array([chr(c).isalnum() for c in range(1 << 16)])
    lower = np.arange(1 << 16, dtype=np.uint32)
    for c in np.flatnonzero(word).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return word, lower


_made: list[np.ndarray] = []


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the lower-cased ones, starts and ends of words, and the first word of each row."""
    if not _made:
        _made.extend(_tables())
    word, lower = _made
    points, rows_at = code_points(data, offsets)
    low = np.where(points < 1 << 16, lower[points & 0xFFFF], points)
    starts, ends = runs(word[points & 0xFFFF] & (points < 1 << 16), rows_at)
    return points, low, starts, ends, np.searchsorted(starts, rows_at)


def text_of(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "replace")


class Automaton:
    """The deterministic intersection of the lexicon's trie with Levenshtein automata of its terms.

    A state is the set of (trie node, edits so far, character owed by a transposition); edits are insertions,
    deletions, substitutions and transpositions of neighbours. Terms below fuzzy in order (all, if it is not
    given) and not too short admit one edit, the rest none. States are built from the trie alone, so matching a word costs one
    table look-up a character whatever the lexicon's size.
    """

    def __init__(self, terms: list[str], fuzzy: int | None = None):
        self.terms = terms
        fuzzy = len(terms) if fuzzy is None else fuzzy
        children: list[dict[str, int]] = [{}]
        ends: list[int | None] = [None]
        soft = [False]  # may a term below this node be matched with an edit?
        for t, term in enumerate(terms):
            node, edit = 0, t < fuzzy and len(term) >= SHORTEST_FUZZY
            soft[0] |= edit
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(None)
                    soft.append(False)
                node = children[node][c]
                soft[node] |= edit
            ends[node] = t
        letters = sorted({c for term in terms for c in term})
        self.classes = np.zeros(1 << 16, np.int32)  # 0: in no term
        for k, c in enumerate(letters):
            self.classes[ord(c)] = k + 1

        def settle(states: set[tuple[int, int, str]]) -> frozenset[tuple[int, int, str]]:
            """With what a deletion reaches; an edit only where a soft term lies ahead."""
            out = set(states)
            for node, edits, owed in states:
                if not edits and not owed:
                    out |= {(x, 1, "") for x in children[node].values() if soft[x]}
            return frozenset(out)

        def step(states: frozenset[tuple[int, int, str]], c: str) -> frozenset[tuple[int, int, str]]:
            out = set()
            for node, edits, owed in states:
                if owed:
                    if owed == c:
                        out.add((node, 1, ""))
                    continue
                if c in children[node] and (not edits or soft[children[node][c]]):
                    out.add((children[node][c], edits, ""))
                if not edits and soft[node]:
                    out.add((node, 1, ""))
                    for x, to in children[node].items():
                        if x != c and soft[to]:
                            out.add((to, 1, ""))
                            if c in children[to] and soft[children[to][c]]:
                                out.add((children[to][c], 1, x))
            return settle(out)

        first = settle({(0, 0, "")})
        known = {frozenset(): 0, first: 1}
        todo, rows = [first], {0: [0] * (len(letters) + 1)}
        while todo:
            states = todo.pop()
            row = []
            for c in ["\0", *letters]:
                to = step(states, c)
                if to not in known:
                    known[to] = len(known)
                    todo.append(to)
                row.append(known[to])
            rows[known[states]] = row
        self.table = np.array([rows[k] for k in range(len(rows))], np.int32)
        self.accepts = np.full(len(rows), -1, np.int32)  # 2 * term + edits; an exact match first, then the better term
        for states, k in known.items():
            found = [(edits, ends[node]) for node, edits, owed in states if ends[node] is not None and not owed and (not edits or (ends[node] < fuzzy and len(terms[ends[node]]) >= SHORTEST_FUZZY))]
            if found:
                edits, term = min(found)
                self.accepts[k] = 2 * term + edits

    def match(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """2 * term + edits for each word, -1 without a match. All words take each step together."""
        out = np.full(len(starts), -1, np.int32)
        at = np.arange(len(starts))
        state = np.ones(len(starts), np.int32)
        place = starts.copy()
        while len(at):
            over = place >= ends[at]
            out[at[over]] = self.accepts[state[over]]
            at, state, place = at[~over], state[~over], place[~over]
            c = low[place]
            state = self.table[state, np.where(c < 1 << 16, self.classes[c & 0xFFFF], 0)]
            live = state > 0
            at, state, place = at[live], state[live], place[live] + 1
        return out


class Lexicon:
    """All terms, however many: an automaton for each block of TABLE_TERMS, so tables grow with the terms' number."""

    def __init__(self, terms: list[str], block: int = TABLE_TERMS):
        self.terms, self.block = terms, block
        self.tables = [Automaton(terms[at : at + block]) for at in range(0, len(terms), block)]

    def match(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As one automaton of all terms would: an exact match first, then the better term."""
        out = np.full(len(starts), -1, np.int32)
        for k, table in enumerate(self.tables):
            found = table.match(low, starts, ends)
            found = np.where(found >= 0, found + 2 * k * self.block, -1)
            better = (found >= 0) & ((out < 0) | (found % 2 < out % 2))  # later blocks' terms are no better
            out = np.where(better, found, out)
        return out


@dataclass
class Model:
    """Terms with their weights (exact, one edit), weights of contexts, and the score's scale."""

    automaton: Automaton | Lexicon
    weights: np.ndarray
    context: dict[int, float] = field(default_factory=lambda: {k: 1.0 for k in PRIOR})
    slope: float = 1.0
    bias: float = -2.0

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, 2 * term + edits, context) of every match of a block."""
        points, low, starts, ends, first = split(data, offsets)
        found = self.automaton.match(low, starts, ends)
        at = np.flatnonzero(found >= 0)
        rows = np.searchsorted(first, at, "right") - 1
        rows_at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(at) else offsets
        spans: dict[int, list[tuple[int, int]]] = {}
        for w, row in zip(at.tolist(), rows.tolist(), strict=True):
            a, b = max(int(first[row]), w - CONTEXT), min(int(first[row + 1]), w + CONTEXT + 1)
            if row not in spans:
                spans[row] = quotations(text_of(points[rows_at[row] : rows_at[row + 1]]))
            place = int(starts[w] - rows_at[row])
            yield row, int(found[w]), context_of(points, low, starts[a:b], ends[a:b], w - a, any(s < place < e for s, e in spans[row]))

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each row's evidence: for every kind of match its weight, its best context, and its count's logarithm."""
        kinds: dict[int, dict[int, list[float]]] = defaultdict(lambda: defaultdict(list))
        for row, kind, context in self.matches(data, offsets):
            kinds[row][kind].append(self.context[context])
        out = np.zeros(len(offsets) - 1)
        for row, found in kinds.items():
            out[row] = sum(self.weights[k] * max(c) * (1 + 0.5 * math.log(len(c))) for k, c in found.items())
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.bias, -30, 30)))


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of the opening and closing mark of every quotation.

    A mark opens after a space and before none, and closes the other way round; in other places its kind tells,
    and apostrophes within words do nothing. A closing mark pairs with the last opening one of its family in the
    paragraph, for single marks in the sentence. A mark without its fellow quotes nothing.
    """
    out: list[tuple[int, int]] = []
    last: dict[int, int] = {}
    for m in _MARK.finditer(text):
        c, at = m.group(), m.start()
        if c == "\n":
            last.clear()
        elif c in ".!?":
            last.pop(_SINGLE, None)
        if c not in _FAMILY:
            continue
        family, before, after = _FAMILY[c], text[at - 1 : at], text[at + 1 : at + 2]
        free_before = not before or before.isspace() or before in "([{—–-" or before in _FAMILY
        free_after = not after or after.isspace() or after in ".,;:!?)]}…—–-" or after in _FAMILY
        if c == "„":
            opens, closes = True, False
        elif free_before != free_after:
            opens, closes = free_before and c != "’", free_after
        elif family == _SINGLE and not free_before and c != "‘":
            continue
        else:
            opens, closes = c in _OPENS, c in _CLOSES
            if not opens and not closes:
                closes = family in last
                opens = not closes
        if closes and family in last:
            out.append((last.pop(family), at))
        elif opens:
            last[family] = at
    return out


def context_of(points: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int, inside: bool = False) -> int:
    """QUOTED if the match stands within quotation marks (inside: of several words) or near a reporting word, DIRECTED near a word of address."""
    near = {text_of(low[s:e]) for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if i != w}
    before = text_of(points[max(0, int(starts[w]) - 2) : int(starts[w])])
    after = text_of(points[int(ends[w]) : int(ends[w]) + 2])
    if inside or any(c in _QUOTES for c in before) and any(c in _QUOTES for c in after) or near & _REPORTING:
        return QUOTED
    return DIRECTED if near & _ADDRESSING else PLAIN


_REPORTING, _ADDRESSING = frozenset(REPORTING.split()), frozenset(ADDRESSING.split())


def training_rows(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic) of about `most` labelled rows outside the held-out fold, chosen by a hash of the id.

    The ids are counted before they are broadcast: about `most` in number, whatever the labels' number.
    A doc_id labelled more than once counts as toxic if any label says so; null ids and labels are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold(id_col, 5) != 0)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = 1 << 30 if n <= most else int((1 << 30) * most / n)
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 30)) < share)
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), id_col).select("text", F.col("toxic").cast("int").alias("toxic"))


def _word_counts(train: DataFrame, rate: float) -> list[tuple[str, int, int]]:
    """(word, toxic contexts, clean texts) of the words whose toxic contexts are too many for chance at this rate.

    A toxic text counts by the two neighbours of the word's first place in it, and equal neighbours count
    once: copies and near copies of one toxic text say no more of its words than the text itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic_seen: set[tuple[str, int]] = set()
        clean: Counter = Counter()
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for at, data, offsets in blocks(batch.column(0)):
                _, low, starts, ends, first = split(data, offsets)
                text = text_of(low)
                words = [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                for r in range(len(offsets) - 1):
                    own = words[first[r] : first[r + 1]]
                    if not toxic[at + r]:
                        clean.update({w for w in own if len(w) >= SHORTEST})
                        continue
                    place: dict[str, int] = {}
                    for i, w in enumerate(own):
                        if len(w) >= SHORTEST:
                            place.setdefault(w, i)
                    for w, i in place.items():
                        toxic_seen.add((w, xxhash.xxh64_intdigest(" ".join(own[max(0, i - 1) : i] + ["."] + own[i + 1 : i + 2])) >> 1))
        rows = [(w, c, 0) for w, c in toxic_seen] + [(w, None, n) for w, n in clean.items()]
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], names=["word", "context", "clean"])

    counted = train.mapInArrow(run, "word string, context long, clean long").groupBy("word", "context").agg(F.sum("clean").alias("clean"))
    counted = counted.groupBy("word").agg(F.count("context").alias("toxic"), F.sum("clean").alias("clean"))
    # Ordered by how often a word speaks for a toxic label, and how clearly; ties by the word.
    gain = F.expr("toxic * ln((toxic + 0.5) / (clean + 0.5))")
    # No rank cuts them: TRAIN_ROWS bounds the text. SURE is asked for with some slack, and exactly by the caller.
    counted = counted.withColumn("clean", F.coalesce("clean", F.lit(0))).where("toxic >= 3 and toxic > clean / 4")
    surprise = F.expr(f"toxic * ln(toxic / (toxic + clean) / {rate!r}D) + if(clean = 0, 0D, clean * ln(clean / (toxic + clean) / {1 - rate!r}D))")
    return [tuple(r) for r in counted.where(surprise > SURE - 0.01).orderBy(F.desc(gain), "word").collect()]


def _surprise(toxic: int, clean: int, rate: float) -> float:
    """Log-likelihood ratio of so many toxic texts with a word against the base rate; 0 if they are no more."""
    n = toxic + clean
    if toxic <= rate * n:
        return 0.0
    return toxic * math.log(toxic / n / rate) + (clean * math.log(clean / n / (1 - rate)) if clean else 0.0)


def _signals(train: DataFrame, model: Model) -> list[tuple]:
    """Of each training text with a match: is it toxic, and its matches as (kind, context)."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for at, data, offsets in blocks(batch.column(0)):
                found: dict[int, Counter] = defaultdict(Counter)
                for row, kind, context in shared.value.matches(data, offsets):
                    found[row][kind, context] += 1
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([int(bool(toxic[at + r])) for r in rows], pa.int32()), pa.array([[x for (k, c), n in sorted(found[r].items()) for x in (k, c, n)] for r in rows], pa.list_(pa.int32()))], names=["toxic", "found"])

    return [(r.toxic, [tuple(r.found[i : i + 3]) for i in range(0, len(r.found), 3)]) for r in train.mapInArrow(run, "toxic int, found array<int>").collect()]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a one-dimensional logistic fit by Newton steps, a little ridge on the slope."""
    slope, bias = 0.5, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
        g = np.array([np.sum(weight * (p - y) * x) + 0.1 * slope, np.sum(weight * (p - y)) + 0.01 * bias])
        v = weight * p * (1 - p)
        h = np.array([[np.sum(v * x * x) + 0.1, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 0.01]])
        change = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, bias = slope - change[0], bias - change[1]
        if np.abs(change).max() < 1e-6:
            break
    return float(max(slope, 0.0)), float(bias)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Model:
    """Lexicon, weights and scale from about `most` labelled rows outside the held-out fold (see training_rows).

    Terms are words whose toxic texts are too many for chance: the likelihood ratio against the base rate
    exceeds SURE, which allows for the number of words looked at. Weights are smoothed log-odds, for a match
    with one edit those of such matches (of all terms of its length if there are few, 0.6 of the exact term's
    while no clean text has any; nothing if they are below 1), at most 0.8 of the exact term's.
    With labels of one kind only, or none, there is no term and every score is the base rate.
    """
    train = training_rows(docs, labels, most, id_col, text_col).cache()
    try:
        totals = dict(train.groupBy("toxic").count().collect())
        n = [sum(v for k, v in totals.items() if not k), sum(v for k, v in totals.items() if k)]
        base = math.log((n[1] + 0.5) / (n[0] + 0.5)) if sum(n) else -2.0
        if not n[0] or not n[1]:
            return Model(Lexicon([]), np.zeros(0), slope=0.0, bias=base)
        log_odds = lambda a, b: math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1))
        scored = [(w, log_odds(a, b)) for w, a, b in _word_counts(train, n[1] / sum(n)) if _surprise(a, b, n[1] / sum(n)) > SURE]
        chosen = [(w, s) for w, s in scored if s >= 1.5 and all(ord(c) < 1 << 16 for c in w)]
        model = Model(Lexicon([w for w, _ in chosen]), np.array([x for _, s in chosen for x in (s, 0.6 * s)]))
        found = _signals(train, model)
    finally:
        train.unpersist()
    # A match with an edit: what labels say of such matches of its term; contexts: of all matches.
    edited: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    contexts = {k: list(v) for k, v in PRIOR.items()}
    for toxic, matches in found:
        for kind in {k for k, _, _ in matches if k % 2}:
            edited[kind][1 - toxic] += 1
        for c in {c for k, c, _ in matches if not k % 2}:
            contexts[c][1 - toxic] += 1
    pooled: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for kind, (a, b) in edited.items():
        of = pooled[min(9, len(model.automaton.terms[kind // 2]))]
        of[0], of[1] = of[0] + a, of[1] + b
    for term, word in enumerate(model.automaton.terms):
        kind, (a, b) = 2 * term + 1, edited[2 * term + 1]
        if a + b < FEW:  # what is known of such matches of terms of this length
            a, b = pooled[min(9, len(word))]
            odds = log_odds(a, b) if b else 0.6 * model.weights[2 * term]
        else:
            odds = log_odds(a, b)
        model.weights[kind] = min(odds, 0.8 * model.weights[2 * term]) if odds >= 1 else 0.0
    rate = {c: a / (a + b) for c, (a, b) in contexts.items()}
    model.context = {c: min(1.2, r / rate[PLAIN]) for c, r in rate.items()}
    x, y = [], []
    for toxic, matches in found:
        kinds: dict[int, list[float]] = defaultdict(list)
        for k, c, count in matches:
            kinds[k] += [model.context[c]] * count
        x.append(sum(model.weights[k] * max(c) * (1 + 0.5 * math.log(len(c))) for k, c in kinds.items()))
        y.append(toxic)
    toxic_none, clean_none = n[1] - sum(y), n[0] - (len(y) - sum(y))
    values = np.array([*x, 0.0, 0.0])
    model.slope, model.bias = _logistic(values, np.array([*y, 1, 0], float), np.array([*[1.0] * len(y), toxic_none, clean_none]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: how likely its whole text is toxic, from 0 to 1.

    Null and empty texts have no evidence and get the base score. Repeated rows stay repeated; other columns
    are ignored; an empty table gives none. The model is broadcast: its size grows with the terms that TRAIN_ROWS
    texts yield, not with docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(shared.value.raw(data, offsets)) for _, data, offsets in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found or [np.zeros(0)]))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def kept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold. Nothing is joined or shuffled."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(shared.value.raw(data, offsets)) for _, data, offsets in blocks(batch.column(column))]
            yield batch.filter(pa.array(np.concatenate(found or [np.zeros(0)]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
