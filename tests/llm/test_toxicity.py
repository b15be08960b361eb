import random

from rankloom.llm import toxicity as t

from . import cases


def near(a, b):
    """Is b within one insertion, deletion, substitution or swap of neighbours of a?"""
    if a == b:
        return 0
    out = {a[:i] + a[i + 1 :] for i in range(len(a))}
    letters = set(a + b)
    out |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    out |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}
    out |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return 1 if b in out else 2


def match(auto, words):
    import numpy as np

    low = np.array([ord(c) for w in words for c in w], np.uint32)
    ends = np.cumsum([len(w) for w in words])
    return auto.match(low, np.concatenate([[0], ends[:-1]]), ends).tolist()


def test_automaton_equals_edit_distance():
    rnd = random.Random(7)
    terms = ["idiot", "moron", "scum", "looser", "réêou", "abab", "ab"]
    auto = t.Automaton(terms, fuzzy=6)
    words = [*terms, "idoit", "id1ot", "idiots", "diot", "scam", "scumm", "a", "abc", "moronn", "mroon", "xidiotx", "漢字"]
    words += ["".join(rnd.choice("abidotscumré1") for _ in range(rnd.randint(1, 7))) for _ in range(2000)]
    for w, found in zip(words, match(auto, words), strict=True):
        best = min(((near(x, w), k) for k, x in enumerate(terms) if near(x, w) == 0 or near(x, w) == 1 and len(x) >= t.SHORTEST_FUZZY and k < 6), default=None)
        assert found == (-1 if best is None else 2 * best[1] + best[0]), w


def test_every_term_is_matched_with_an_edit():
    rnd = random.Random(3)
    terms = sorted({"".join(rnd.choice("abcdeiorstu") for _ in range(rnd.randint(4, 9))) for _ in range(530)})
    rnd.shuffle(terms)
    words = [w[:i] + w[i + 1 :] for w in terms[380:] for i in (1,)] + terms
    got = match(t.Lexicon(terms), words)
    for w, found in zip(words, got, strict=True):
        assert found == min(((near(x, w), k) for k, x in enumerate(terms) if abs(len(x) - len(w)) < 2 and near(x, w) < 2), default=(0, 0))[1] * 2 + (w not in terms), w


def test_no_term_is_cut_by_rank(spark):
    rnd = random.Random(4)
    name = lambda k: "q" + "".join("bcdfgklmnp"[int(c)] for c in f"{k:05d}")
    rows = []
    for _ in range(10):  # each term in ten toxic texts, ten terms a text
        dealt = rnd.sample(range(450), 450)
        rows += [(len(rows) + j, " ".join(f"{name(k)} z{rnd.randint(0, 10**9)}" for k in dealt[j * 10 : j * 10 + 10]), "en", "a", 1) for j in range(45)]
    rows += [(450 + j, f"{rnd.random():.9f} plain words", "en", "a", 1) for j in range(4500)]
    labels = [(r[0], 1, int(r[0] < 450)) for r in rows]
    found = set(t.learn(cases.docs(spark, rows), cases.labels(spark, labels), most=50_000).automaton.terms)
    assert len({name(k) for k in range(450)} & found) > 400


def test_context(spark):
    import numpy as np

    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [c for _, _, c in t.Model(t.Automaton(["idiot"]), np.array([5.0, 3.0])).matches(data, np.array([0, len(data)]))]

    assert of("he went by, an idiot of sorts") == [t.PLAIN]
    assert of('the sign had "idiot" on it') == [t.QUOTED]
    assert of("she said idiot was the word") == [t.QUOTED]
    assert of("you are an idiot") == [t.DIRECTED]
    assert of("İ 漢字 you idoit") == [t.DIRECTED]


def test_quotations_of_several_words():
    import numpy as np

    model = t.Model(t.Automaton(["idiot"]), np.array([5.0, 3.0]))

    def of(*texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        return [c for _, _, c in model.matches(data, np.cumsum([0, *[len(x.encode()) for x in texts]]))]

    for quoted in (
        'He shouted "you stupid idiot, go away" at him',
        "He shouted “you are such a big idiot. Go away, at once, and never come back to us” at him",
        "Er rief „du bist ein großer idiot, geh weg“ und ging",
        "Er rief »du bist ein großer idiot, geh weg« und ging",
        "Il cria « tu es un grand idiot, va » et partit",
        "He shouted 'you aren't an idiot at all' at him",
    ):
        assert of(quoted) == [t.QUOTED], quoted
    for plain in ('"Go away, you idiot', '"Go away" he cried, you big idiot, "and stay there"', "don't you idiot think it's over", 'a 5" pipe, you idiot', 'the "end\nyou big idiot now\n" of it', "the dogs' you idiot friends' house"):
        assert of(plain) == [t.DIRECTED], plain
    assert of('"', "you idiot", '"', 'ö "oh you big idiot there"') == [t.DIRECTED, t.QUOTED]


def corpus(n=900):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 60))]
        if toxic:
            for w in rnd.sample(["wretchling", "dunderhead", "nitwittery"], 2):
                words.insert(rnd.randint(0, len(words)), w)
        rows.append((i, " ".join(words), "en", "a", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_scores_and_catches_misspellings(spark):
    rows, labels = corpus()
    rows += [(5000, "and so the wretchlnig spoke with a dunderhaed there", "en", "a", 1), (5001, None, None, None, None), (5002, "", "en", "a", 0)]
    docs = cases.docs(spark, rows)
    model = t.learn(docs, cases.labels(spark, labels))
    assert {"wretchling", "dunderhead", "nitwittery"} <= set(model.automaton.terms)
    got = {r.doc_id: r.score for r in t.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    wrong = [i for i in range(900) if (got[i] >= 0.5) != (i % 6 == 0)]
    assert len(wrong) <= 2
    assert got[5000] >= 0.5 and got[5001] == got[5002] < 0.5
    kept = t.kept(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_awkward_rows_and_no_labels(spark):
    docs = cases.docs(spark)
    out = t.op2_rows(docs, cases.labels(spark)).collect()
    assert len(out) == len(cases.ROWS) and all(r.predicted == int(r.score >= 0.5) for r in out)
    one_kind = cases.labels(spark, [(1, 1, 1), (1, 1, 0), (3, 1, None), (None, 1, 1)])
    assert t.op2_rows(docs, one_kind).count() == len(cases.ROWS)
    assert t.op2_rows(cases.docs(spark, []), cases.labels(spark)).collect() == []


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus()
    docs = cases.docs(spark, rows)
    import zlib

    flipped = [(i, q, 1 - x) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, x) for i, q, x in labels]
    a, b = (t.op2_rows(docs, cases.labels(spark, x)).collect() for x in (labels, flipped))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
