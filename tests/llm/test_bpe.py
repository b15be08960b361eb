import hashlib
import random

import numpy as np
import pytest

from rankloom.llm import bpe
from rankloom.llm.queries import tokenizer_path

from . import cases

pytest.importorskip("public_tokenizers")
PIECES = ["a", "The", "́", "é", "é", "Σ", "ΑΣ ", " ", " ", " ", "\n", "\t", "<|endoftext|>", "<|startoftext|", "İ", "ß", "漢字", "😀", "'s", "don't", "1234", "!!", "‍", "\x0b", "\x1c", "\x85", "𐍈", "ﬁ", "É", "×", "÷", "ÀÖØÿ", "<|", "\x7f", "</w>", "\xa0", "à", "²", "ª"]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def say(rnd, n):
    return "".join(rnd.choice(PIECES) for _ in range(n))


def test_exact_with_reused_chunks_and_odd_characters(tok, monkeypatch):
    rnd, codec = random.Random(1), bpe.Codec(tokenizer_path())
    planted = []
    monkeypatch.setattr(bpe, "known_middles", lambda data, offsets, known: planted if known else [])
    for _ in range(150):
        texts = [say(rnd, rnd.randint(0, 60)) for _ in range(6)]
        raw = [t.encode() for t in texts]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        planted.clear()
        for k, r in enumerate(raw):  # any cut between characters, any chunk known
            cuts = sorted({p for p in (rnd.randint(0, len(r)) for _ in range(6)) if p == len(r) or r[p] & 0xC0 != 0x80} | {len(r)})
            for a, b in zip([0, *cuts], cuts, strict=False):
                edge = bpe.sides(r[a:b])
                if edge and edge[0] < edge[1] and rnd.random() < 0.5:
                    middle = np.frombuffer(r[a:b][edge[0] : edge[1]], np.uint8)
                    ids, _, text, _ = bpe.encode_block(middle, np.array([0, len(middle)]), codec, {})
                    if len(ids):
                        planted.append((int(at[k]) + a + edge[0], int(at[k]) + a + edge[1], ids.tobytes(), text.tobytes() + b" "))
        ids, id_at, text, text_at = bpe.encode_block(data, at, codec, {b"": 1})
        for k, t in enumerate(texts):
            assert (ids[id_at[k] : id_at[k + 1]].tolist(), text[text_at[k] : text_at[k + 1]].tobytes().decode()) == expected(tok, t), repr(t)


def test_chunks_depend_on_their_own_text_alone():
    rnd = np.random.default_rng(0)
    shared = rnd.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    def cut(text, before=b""):
        data = np.frombuffer(before + text, np.uint8)
        at = np.array([0, len(before), len(before) + len(text)])
        return [c - len(before) for c in bpe.cut_points(data, at).tolist() if c > len(before)]
    assert cut(shared) == cut(shared, b"another text of some length that comes first in the block")
    inner = {shared[a:b] for a, b in zip([0, *cut(shared)], cut(shared), strict=False)}
    moved = b"xyz " * 9 + shared
    again = {moved[a:b] for a, b in zip([0, *cut(moved)], cut(moved), strict=False)}
    assert len(inner & again) >= len(inner) - 2 > 10


def rows_of(df):
    return sorted(((r.doc_id, list(r.ids), r.decoded) for r in df.collect()), key=str)


def test_documents(spark, tok):
    passage = say(random.Random(2), 900)
    rows = [*cases.ROWS, *[(100 + k, f"{say(random.Random(k), 40)} {passage} {k}", "en", "a", 1) for k in range(12)]]
    docs = cases.docs(spark, rows)
    want = sorted(((r[0], *expected(tok, r[1])) for r in rows), key=str)
    assert bpe.chunk_census(docs).count()
    for bits in (bpe.FILTER_BITS, 256, 64):  # however full the filter
        assert rows_of(bpe.encode_documents(docs, tokenizer_path(), filter_bits=bits)) == want
    digests = {r.doc_id: r for r in bpe.op5_digest(bpe.encode_documents(docs, tokenizer_path())).collect()}
    for i, ids, text in want:
        d = digests[i]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_every_shared_chunk_is_encoded_once(spark, tok):
    words = random.Random(3)
    passages = [" ".join(f"w{words.randint(0, 9999)}" for _ in range(800)) for _ in range(5)]
    rows = [(k, f"start {k} {passages[k % 5]} {k} end {passages[(k + 1) % 5]}", "en", "a", 1) for k in range(40)]
    rows += [(1000, passages[0], "en", "a", 1)] * 300  # one row a great many times
    docs = cases.docs(spark, rows).repartition(7)
    census = {bytes(r.key): r.n for r in bpe.chunk_census(docs).collect()}
    chunks = bpe.Counter(bpe.chunk_key(c) for r in rows for c in next(bpe._rows(np.frombuffer(r[1].encode(), np.uint8), np.array([0, len(r[1].encode())]))))
    assert census == {k: n for k, n in chunks.items() if n > 1}
    marks = spark.sparkContext.broadcast(bpe.key_filter(bpe.chunk_census(docs)))
    made = bpe.encoded_chunks(docs, tokenizer_path(), marks).collect()
    assert len({bytes(r.key) for r in made}) == len(made)
    assert {bytes(r.key): r.n for r in made} == census  # all have white space here
    assert sum(census.values()) > 5 * len(census) > 100
    want = sorted(((r[0], *expected(tok, r[1])) for r in rows), key=str)
    assert rows_of(bpe.encode_documents(docs, tokenizer_path())) == want


def test_known_chunks_are_used(tok):
    text = " ".join(f"w{k}" for k in range(900)).encode()
    data, at, codec = np.frombuffer(text, np.uint8), np.array([0, len(text)]), bpe.Codec(tokenizer_path())
    chunk = max(next(bpe._rows(data, at)), key=len)
    head, tail = bpe.sides(chunk)
    ids, _, _, _ = bpe.encode_block(data, at, codec, {bpe.chunk_key(chunk): (head, tail, *codec.entry([7]))})
    whole = tok.encode(text.decode(), add_special_tokens=False).ids
    middle = tok.encode(chunk[head:tail].decode(), add_special_tokens=False).ids
    assert len(ids) == len(whole) - len(middle) + 1 and 7 in ids


def test_empty(spark):
    assert bpe.encode_documents(cases.docs(spark, []), tokenizer_path()).collect() == []


def test_path_is_a_parameter(spark, tok, tmp_path):
    import shutil

    at = shutil.copy(tokenizer_path(), tmp_path / "own.json")
    rows = bpe.encode_documents(cases.docs(spark, cases.ROWS[:1]), str(at)).collect()
    assert rows[0].ids == expected(tok, cases.PLAIN)[0]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="normalizer"):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
