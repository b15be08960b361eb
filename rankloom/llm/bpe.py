"""BPE encoding and decoding with reuse of content-defined chunks and exact repair of their joins."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import blocks, mix, powers, runs, skew_join, span_hashes, stored

#: Bytes of the rolling window; a chunk ends on average after 2**CHUNK_BITS bytes and never before MIN_CHUNK.
WINDOW, CHUNK_BITS, MIN_CHUNK = 32, 9, 64
#: Bits of the broadcast filter of shared chunks' keys (16 MB at any size of the corpus), and pieces of words that a task remembers twice over.
FILTER_BITS, MEMO_PIECES = 1 << 27, 150_000
#: Bytes of text that are encoded at a time, and rows whose shared chunks are held at a time.
BLOCK_BYTES, SLICE_ROWS = 1 << 20, 1024
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Classes of bytes: white space, letters, digits, other signs, and those whose words go to the tokenizer whole
#: (controls, apostrophes for their contractions, and bytes beyond ASCII but for Latin-1's letters).
_WHITE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)
_CLASS = np.full(256, _WHOLE, np.uint8)
_CLASS[0x21:0x7F], _CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x27] = _SIGN, _DIGIT, _LETTER, _LETTER, _WHOLE
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _WHITE
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a block, rows' ends included, chosen by a hash of the WINDOW bytes before them.

    The hash rolls over each text alone, so a passage gets the same chunks in whatever text it stands, but
    for those at its edges. A cut never falls inside a UTF-8 character.
    """
    n = len(data)
    ends = offsets[1:]
    if n <= WINDOW:
        return np.unique(ends)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    rolled = (total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1]  # of the window that ends before WINDOW + i
    hit = np.flatnonzero(rolled >> np.uint64(64 - CHUNK_BITS) == 0) + WINDOW
    hit = hit[hit < n]
    hit = hit[(data[hit] & 0xC0) != 0x80]
    row = np.searchsorted(offsets, hit, "right") - 1
    hit = hit[hit - offsets[row] >= WINDOW]
    # Of hits in a run closer than MIN_CHUNK only the first counts: again a rule on the text around alone.
    if len(hit):
        row = np.searchsorted(offsets, hit, "right")
        hit = hit[np.concatenate([[True], (np.diff(hit) >= MIN_CHUNK) | (np.diff(row) > 0)])]
    return np.unique(np.concatenate([hit, ends]))


def chunks_of(raw: bytes, cuts: list[int], start: int, end: int) -> list[bytes]:
    """The chunks of the text raw[start:end], given the block's sorted cut points within it."""
    edges = [start, *cuts]
    return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False) if b > a]


def _rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
    """The chunks of each row of a block."""
    raw, cuts = data.tobytes(), cut_points(data, offsets)
    low, high = np.searchsorted(cuts, offsets[:-1], "right"), np.searchsorted(cuts, offsets[1:], "right")
    for r in range(len(offsets) - 1):
        yield chunks_of(raw, cuts[low[r] : high[r]].tolist(), int(offsets[r]), int(offsets[r + 1]))


def chunk_key(chunk: bytes) -> bytes:
    """128 bits by which a chunk is known."""
    return xxhash.xxh3_128_digest(chunk)


#: What the cuts below rely on (fixed values of the tokenizer's file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def check_tokenizer(tokenizer: Tokenizer) -> None:
    """Raise unless the tokenizer normalises, splits and decodes as cut_pieces and Codec assume; its vocabulary is free."""
    known = json.loads(tokenizer.to_str())
    split = (known["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    model = known["model"]
    as_assumed = {
        "normalizer": known["normalizer"] == NORMALIZER,
        "pre-tokenizer": split[0].get("pattern") == {"Regex": SPLIT} and split[0].get("invert") is True and [x["type"] for x in split] == ["Split", "ByteLevel"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"],
        "decoder": known["decoder"] is None and known["post_processor"] is None,
        "model": model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["dropout"] and not model["byte_fallback"] and not model["continuing_subword_prefix"] and not model.get("ignore_merges"),
        "special tokens": all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in known["added_tokens"]),
    }
    if wrong := [k for k, ok in as_assumed.items() if not ok]:
        raise ValueError(f"the tokenizer's {', '.join(wrong)} cannot be encoded by pieces of words")


class Codec:
    """The tokenizer at path, with a bounded memory of pieces of words.

    White space in ASCII ends a pre-token of this tokenizer, is dropped by it, composes with nothing under
    NFC and stands in no special token. So the encoding of a text is that of its words between such white
    space, one after the other: a cut there is exact, and one elsewhere is repaired by encoding the word
    around it again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        check_tokenizer(self.tokenizer)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.ends = np.array([n.endswith(WORD_END) for n in self.names])
        # piece: its ids as int32 bytes, and their decoded text with a space after it. Pieces that go to the
        # tokenizer whole are under (piece,). What was not used for MEMO_PIECES others is forgotten.
        self.memo: dict = {}
        self.older: dict = {}

    def entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as int32 bytes, and their decoded text with a space after it."""
        return array("i", ids).tobytes(), "".join([self.names[i] + " " for i in ids]).encode()

    def entries(self, pieces: list) -> list[tuple[bytes, bytes]]:
        """Of each piece its ids and decoded text; those not remembered are encoded, a batch at a time."""
        if len(self.memo) > MEMO_PIECES:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = []
        for p in pieces:
            if p not in memo:
                if (found := older.get(p)) is not None:
                    memo[p] = found
                else:
                    new.append(p)
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            whole = [p for p in part if isinstance(p, tuple)]
            plain = [p for p in part if not isinstance(p, tuple)]
            for p, e in zip(whole, self.tokenizer.encode_batch_fast([p[0].decode("utf-8", "replace") for p in whole], add_special_tokens=False), strict=True):
                memo[p] = self.entry(e.ids)
            # Plain pieces are one text, told apart by the tokens that end a pre-token; each alone if these don't tell.
            texts = [p.decode() for p in plain]
            ids = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids if texts else []
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist() if ids else []
            if len(ends) == len(plain):
                lists = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            for p, own in zip(plain, lists, strict=True):
                memo[p] = self.entry(own)
        return [memo[p] for p in pieces]


_codecs: dict[str, Codec] = {}


def codec_at(path: str) -> Codec:
    """The worker's codec; its memory of pieces outlives a task where Spark reuses the worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a block's words: its bytes (lower-cased), starts, ends, and whether a piece is a whole word.

    Words of ASCII and of Latin-1's letters, which NFC leaves as they are and whose lower case is one letter,
    are cut into the pre-tokens that the tokenizer cuts them into: runs of letters, single digits, runs of
    other signs. A word with anything else stays whole and as it is.
    """
    kind = _CLASS[data]
    follow = np.append(data[1:], np.uint8(0))
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    # À to ÿ without × and ÷ are two bytes, the first 0xC3; upper case is 0x20 below lower case.
    pair = np.flatnonzero((data == 0xC3) & (follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7))
    kind[pair] = kind[pair + 1] = _LETTER
    upper = pair[follow[pair] <= 0x9E] + 1
    low[upper] += 0x20
    kind[(data == 0x3C) & (follow == 0x7C)] = _WHOLE  # a special token may begin here
    starts, ends = runs(kind != _WHITE, offsets)
    before = np.concatenate([[0], np.cumsum(kind == _WHOLE)])
    whole = before[ends] > before[starts]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[whole]] = 1
    inside[ends[whole]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    first = np.zeros(len(data), bool)
    first[starts] = True
    change = np.append(True, kind[1:] != kind[:-1])
    head = np.flatnonzero((kind != _WHITE) & (first | ((change | (kind == _DIGIT)) & ~inside)))
    word = np.searchsorted(starts, head, "right") - 1
    tail = np.minimum(np.append(head[1:], len(data)), ends[word])
    return np.where(inside, data, low), head, tail, whole[word]


def sides(chunk: bytes) -> tuple[int, int] | None:
    """Where the chunk's first white space stands and where its last ends; None if it has none."""
    first = _SPACE.search(chunk)
    if not first:
        return None
    return first.start(), len(chunk) - len(chunk.rsplit(None, 1)[-1]) if not chunk[-1:].isspace() else len(chunk)


def known_middles(data: np.ndarray, offsets: np.ndarray, known: dict) -> list[tuple[int, int, bytes, bytes]]:
    """Where a block's known chunks have their middles: start, end, ids and decoded text of each, in order."""
    out = []
    if known:
        raw, cuts = data.tobytes(), cut_points(data, offsets).tolist()
        for a, b in zip([0, *cuts], cuts, strict=False):
            if (one := known.get(chunk_key(raw[a:b]))) is not None and one[0] < one[1]:
                out.append((a + one[0], a + one[1], one[2], one[3]))
    return out


def _gather(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[at : at + n] of every item, one after the other."""
    ends = np.cumsum(n)
    return pool[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode_block(data: np.ndarray, offsets: np.ndarray, codec: Codec, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's texts: all ids and their offsets, all decoded bytes and their offsets.

    A known chunk brings the encoding of its middle, from its first white space to its last. What is left,
    unknown chunks and what stands around a join (from the last white space before it to the first after it,
    over as many chunks as have none), is encoded from the text as it stands there, so the ids agree exactly
    with those of the whole text. Each distinct piece of a block is looked up or encoded once.
    """
    if not len(data):
        none = np.zeros(len(offsets), np.int64)
        return np.zeros(0, np.int32), none, np.zeros(0, np.uint8), none
    middles = known_middles(data, offsets, known)
    low, starts, ends, whole = cut_pieces(data, offsets)
    if middles:
        edges = np.array([m[:2] for m in middles])
        place = np.searchsorted(edges[:, 0], starts, "right") - 1
        left = (place < 0) | (starts >= edges[np.maximum(place, 0), 1])
        starts, ends, whole = starts[left], ends[left], whole[left]
    up, down = powers(len(data) + 1)
    hashes = span_hashes(low, starts, ends) ^ whole.astype(np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[low] * up[: len(data)], out=total[1:])
    check = (total[ends] - total[starts]) * down[starts]
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    if not np.array_equal(check[first][inverse], check):  # two pieces of one hash: tell every piece apart
        first = inverse = np.arange(len(hashes))
    raw = low.tobytes()
    pieces = [raw[a:b] if not w else (raw[a:b],) for a, b, w in zip(starts[first].tolist(), ends[first].tolist(), whole[first].tolist(), strict=True)]
    found = codec.entries(pieces) + [(m[2], m[3]) for m in middles]
    at, item = starts, inverse
    if middles:
        at, item = np.concatenate([starts, edges[:, 0]]), np.concatenate([inverse, len(pieces) + np.arange(len(middles))])
        order = np.argsort(at, kind="stable")
        at, item = at[order], item[order]
    row = np.searchsorted(offsets, at, "right") - 1
    out = []
    for k, dtype in ((0, np.int32), (1, np.uint8)):
        pool = np.frombuffer(b"".join([f[k] for f in found]), dtype)
        n = np.array([len(f[k]) for f in found], np.int64) // np.dtype(dtype).itemsize
        begin = np.cumsum(n) - n
        values = _gather(pool, begin[item], n[item])
        sizes = np.bincount(row, n[item], len(offsets) - 1).astype(np.int64)
        if k:  # no space after a text's last token
            last = np.cumsum(sizes)[sizes > 0] - 1
            values, sizes = np.delete(values, last), sizes - (sizes > 0)
        out += [values, np.concatenate([[0], np.cumsum(sizes)])]
    return tuple(out)


def chunk_census(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n) of the chunks that occur at least twice in docs, counted over all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                held = Counter(chunk_key(c) for chunks in _rows(data, offsets) for c in chunks)
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def key_filter(census: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set for every key of the census, as 64-bit words; bits is a power of two of at least 64.

    Its size does not grow with the corpus. A key that is not in the census may find its bit set: such a
    chunk is looked up like a shared one, to the same ids, and costs an exchange that it did not need.
    """
    slot = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1))
    slots = census.select(slot.alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def marked_chunks(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """A block's chunks whose keys have their bit set in marks: row, key and text of each, in order."""
    if not len(data):
        return []
    raw, cuts = data.tobytes(), cut_points(data, offsets)
    cuts = cuts[cuts > 0]
    starts = np.concatenate([[0], cuts[:-1]])
    keys = [chunk_key(raw[a:b]) for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)]
    slot = np.frombuffer(b"".join(keys), ">u4")[::4].astype(np.int64) & (len(marks) * 64 - 1)
    hit = np.flatnonzero((marks[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
    row = np.searchsorted(offsets, starts[hit], "right") - 1
    return [(r, keys[k], raw[starts[k] : cuts[k]]) for r, k in zip(row.tolist(), hit.tolist(), strict=True)]


def marked_rows(column: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Whether each text of a column has a marked chunk."""
    out = np.zeros(len(column), bool)
    for at, data, offsets in blocks(column):
        out[[at + r for r, _, _ in marked_chunks(data, offsets, marks)]] = True
    return out


def encoded_chunks(docs: DataFrame, tokenizer_path: str, marks: Broadcast, text_col: str = "text") -> DataFrame:
    """Every marked chunk, encoded once: (key, n, head, tail, ids), from head to tail of the chunk as int32 bytes.

    n counts the chunk's occurrences. Chunks without two white spaces around a word have no row.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                found: dict[bytes, list] = {}
                for _, key, chunk in marked_chunks(data, offsets, marks.value):
                    found.setdefault(key, [chunk, 0])[1] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([v[0] for v in found.values()], pa.binary()), pa.array([v[1] for v in found.values()], pa.int64())], names=["key", "chunk", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(tokenizer_path)
        for batch in batches:
            rows = [(key, n, *edge, chunk[edge[0] : edge[1]]) for key, chunk, n in zip(*[c.to_pylist() for c in batch.columns], strict=True) if (edge := sides(chunk)) is not None and edge[0] < edge[1]]
            ids, id_at, _, _ = encode_block(np.frombuffer(b"".join([r[4] for r in rows]), np.uint8), np.cumsum([0, *[len(r[4]) for r in rows]]), codec, {})
            made = [(*r[:4], ids[id_at[k] : id_at[k + 1]].tobytes()) for k, r in enumerate(rows) if id_at[k + 1] > id_at[k]]
            columns = zip(*made, strict=True) if made else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "n", "head", "tail", "ids"])

    texts = docs.select(F.col(text_col).cast("string")).mapInArrow(fetch, "key binary, chunk binary, n long")
    once = texts.groupBy("key").agg(F.first("chunk").alias("chunk"), F.sum("n").alias("n"))
    return once.mapInArrow(encode, "key binary, n long, head int, tail int, ids binary")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def encode_batches(batches: Iterator[pa.RecordBatch], codec: Codec, known: dict[bytes, tuple[int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, decoded) of batches of (doc_id, text), a block of texts at a time."""
    for batch in batches:
        for at, data, offsets in blocks(batch.column(1), BLOCK_BYTES):
            ids, id_at, decoded, text_at = encode_block(data, offsets, codec, known)
            n = len(offsets) - 1
            texts = pa.StringArray.from_buffers(n, pa.py_buffer(text_at.astype(np.int32)), pa.py_buffer(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(id_at, pa.int32()), pa.array(ids)), texts], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs: token ids of the whole text, and the text decoded from them.

    The same ids as the tokenizers library gives without added special tokens, truncation and padding
    (strings of special tokens in a text are special, as there), and the same text as its decode() without
    skipping special tokens. Null text is empty; empty text has no ids. Repeated rows stay repeated; other
    columns are ignored; an empty table gives none.

    Method: a rolling hash cuts texts into content-defined chunks. Every chunk that occurs more than once is
    encoded once, in a table by its key, and joined to the documents that hold it; what no chunk covers is
    encoded where it stands. Joins of chunks are repaired so that they agree exactly (encode_block).
    Texts with a marked chunk (see key_filter) meet their chunks' ids in one exchange; all others stay where
    they are. docs is scanned five times and must give the same rows each time.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    marks = spark.sparkContext.broadcast(key_filter(chunk_census(rows), filter_bits))
    shared = stored(encoded_chunks(rows, tokenizer_path, marks))
    total = shared.agg(F.sum("n")).first()[0] or 0
    # Rows of one key may be several: their chunks are told apart by the chunks' own keys.
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rest = batch.filter(pa.array(~marked_rows(batch.column(1), marks.value)))
            yield from encode_batches([rest], codec_at(tokenizer_path), {})

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(marked_rows(batch.column(2), marks.value)))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in blocks(batch.column(1)):
                pairs = list(dict.fromkeys((at + r, key) for r, key, _ in marked_chunks(data, offsets, marks.value)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([p[0] for p in pairs], pa.int64())), pa.array([p[1] for p in pairs], pa.binary())], names=["row", "key"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(tokenizer_path)
        for batch in slices(batches):
            known = {}
            for key, head, tail, ids in zip(*[c.to_pylist() for c in batch.column(2).flatten().flatten()], strict=True):
                if key not in known:
                    known[key] = (head, tail, *codec.entry(np.frombuffer(ids, np.int32).tolist()))
            yield from encode_batches([batch], codec, known)

    made = f"doc_id {kind}, ids array<int>, decoded string"
    held = keyed.select("row", "text").mapInArrow(occurrences, "row long, key binary").distinct()
    parts = skew_join(held, shared, "key", "n", total).groupBy("row").agg(F.collect_list(F.struct("key", "head", "tail", "ids")).alias("known"))
    texts = keyed.mapInArrow(holders, f"row long, doc_id {kind}, text string")
    met = texts.join(parts, "row", "left").select("doc_id", "text", "known").mapInArrow(joined, made)
    return rows.mapInArrow(alone, made).unionByName(met)


def op5_digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns from encode_documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
