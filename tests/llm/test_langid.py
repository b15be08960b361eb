import zlib
from collections import Counter

import numpy as np

from rankloom.llm import langid

from . import cases


def slow_grams(text):
    words, word = [], ""
    for c in text or "":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    if not words:
        return Counter()
    line = " " + " ".join(words) + " "
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if n > 1 or line[i] != " ")


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_grams_equal_brute_force():
    texts = ["", "a", "...", "ab, cd!", " É1é ", "Ab\nab", "x" * 5, "漢字 ß", "", "1 2", "😀😀", "𐐀𐐨b 𝒜", "😀a"]
    raw = [t.encode() for t in texts]
    row, gram, count = langid.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        got = {int(g): int(c) for r, g, c in zip(row, gram, count, strict=True) if r == k}
        assert got == {number(g): c for g, c in slow_grams(t).items()}, t


def test_many_rows_and_characters_in_one_block():
    """Row and n-gram do not fit one integer: rows past 2**16, and more characters than a few alphabets have."""
    texts = [chr(0x4E00 + i % 9000) + "ab"[i % 2] for i in range(70_000)]
    raw = [t.encode() for t in texts]
    row, gram, count = langid.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.bincount(row).tolist() == [2 + 3 + 2] * len(texts) and set(count.tolist()) == {1}
    for k in (0, 1, 65_535, 65_536, 69_999):
        assert set(gram[row == k].tolist()) == {number(g) for g in slow_grams(texts[k])}


def test_no_letter_is_und(spark):
    rows = [*corpus(), (9001, "😀😀", "aa", "s", 2), (9002, "١٢٣ 12", None, "s", 1), (9003, "𝒜𝒜", None, "s", 1)]
    out = {r.doc_id: r for r in langid.op6_rows(cases.docs(spark, rows)).collect()}
    assert (out[9001].lang_pred, out[9001].score) == ("und", 0.0) == (out[9002].lang_pred, out[9002].score)
    assert out[9003].lang_pred != "und"


def corpus():
    import random

    rnd = random.Random(3)
    kinds = {"aa": ["kal", "mor", "tin"], "bb": ["uws", "eej", "yyp"], "cc": ["kaw", "éèç", "ñoñ"]}
    rows = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(rnd.choice(kinds[lang]) for _ in range(2)) for _ in range(rnd.randint(3, 30))), lang, "s", 1))
    return rows


def slow_predict(profiles, text, size):
    top = sorted(slow_grams(text).items(), key=lambda x: (-x[1], number(x[0])))[:size]
    if not top:
        return "und"
    far = {lang: sum(abs(p[g] - r) if g in p else size for r, (g, _) in enumerate(top)) for lang, p in profiles.items()}
    return min(sorted(far), key=far.get)


def test_predictions_equal_brute_force(spark):
    rows = [*corpus(), *[(1000 + (r[0] or 0), *r[1:]) for r in cases.ROWS]]
    docs = cases.docs(spark, rows)
    size = 40
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts = {}
    for i, text, lang, _, _ in rows:
        if lang is not None and not held(i):
            counts.setdefault(lang, Counter()).update(slow_grams(text))
    profiles = {lang: {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[:size])} for lang, c in counts.items()}
    model = langid.learn_profiles(docs.where(langid.fold("doc_id", 3) != 1), size=size)
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect())
    assert got == sorted((i, slow_predict(profiles, text, size)) for i, text, *_ in rows)


def test_contract(spark):
    rows = corpus()
    docs = cases.docs(spark, rows)
    out = langid.op6_rows(docs).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    right = [r.lang_pred == "abc"[r.doc_id % 3] * 2 for r in out if r.held_out]
    assert sum(right) / len(right) > 0.98


def test_awkward_rows(spark):
    out = langid.op6_rows(cases.docs(spark)).collect()
    assert len(out) == len(cases.ROWS)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {2, 3, 4, 9}
    assert langid.op6_rows(cases.docs(spark, [])).collect() == []
    nothing = langid.identify(cases.docs(spark), langid.learn_profiles(cases.docs(spark).where("lang is null and false")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
