import random

import numpy as np
import xxhash

from rankloom.llm import components, simhash

from . import cases


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, radius=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def rows_of(df):
    return sorted(((r.doc_id, r.fp, r.component_id) for r in df.collect()), key=str)


def test_fingerprint_matches_definition():
    for text in ["", " ", "a", "a b c", "A b C d", "a b c d e f a b c d", "É\x0bÀ x y z \x1c q", cases.PLAIN]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_awkward_rows(spark):
    got = rows_of(simhash.simhash_groups(cases.docs(spark)))
    ids, texts = [r[0] for r in cases.ROWS], [r[1] for r in cases.ROWS]
    fps = [slow_fingerprint(t) for t in texts]
    want = sorted(zip(ids, np.array(fps, np.uint64).view(np.int64).tolist(), slow_components(ids, fps), strict=True), key=str)
    assert got == want


def test_empty(spark):
    assert simhash.simhash_groups(cases.docs(spark, [])).collect() == []


def test_links_are_whole_in_hot_blocks(spark):
    """Many fingerprints that agree in all bands but a few bits: blocks are cut into many tiles."""
    rnd = random.Random(3)
    base, fps = 0x123456789ABCDEF0, set()
    while len(fps) < 700:
        x = base
        for b in rnd.sample(range(64), rnd.randint(0, 9)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for tile in (16, 64, 4096):
        links = simhash.fingerprint_links(df, len(fps), 4, tile)
        roots = {r.node: r.root for r in components.connected_components(links).collect()}
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        want = slow_components(signed, fps)
        groups = {}
        for s, w in zip(signed, want, strict=True):
            groups.setdefault(w, []).append(roots.get(s, s))
        assert all(len(set(v)) == 1 for v in groups.values())
        assert len({v[0] for v in groups.values()}) == len(groups)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)}


def test_no_pair_is_lost_by_tiles():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 63, 900).astype(np.uint64)
    a[300:600] = a[:300] ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64))
    found = {tuple(sorted(p)) for x, y in simhash.close_pairs(a, None, 4, 64) for p in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if int(a[i] ^ a[j]).bit_count() <= 4}
    assert found == want
    across = {p for x, y in simhash.close_pairs(a[:450], a[450:], 4, 64) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert across == {(i, j - 450) for i, j in want if i < 450 <= j}


def test_kept_loses_no_group(spark):
    """One row of each group of rows: repeated ids on different texts, null ids, near copies, ties, whole repeats."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    near = b + " end"
    rows = [
        (1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, near, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "t", 1), (None, a, "en", "s", 1),
        (7, c, "en", "s", 1), (7, c, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "x y", "en", "s", 3), (None, "x y", "en", "s", 3),
    ]
    rnd = random.Random(5)
    for k in range(40):
        rows.append((rnd.choice([None, *range(20, 32)]), rnd.choice([a, b, c, f"{k % 9} text of its own " + " ".join(f"w{k % 9}{i}" for i in range(60))]), "en", f"s{k % 3}", 5))
    fps = [slow_fingerprint(r[1]) for r in rows]
    group = slow_components(list(range(len(rows))), fps)
    want = {}
    for r, g in zip(rows, group, strict=True):
        want.setdefault(g, []).append(r)
    best = {g: min((r[0] is None, r[0] or 0) for r in members) for g, members in want.items()}
    first = None
    for parts in (1, 7):
        rnd.shuffle(rows)
        got = [tuple(r)[:5] for r in simhash.kept(cases.docs(spark, rows).repartition(parts)).collect()]
        by_group = {}
        for r in got:
            by_group.setdefault(next(g for g, m in want.items() if r in m), []).append(r)
        assert sorted(by_group) == sorted(want) and all(len(v) == 1 for v in by_group.values())
        assert all((v[0][0] is None, v[0][0] or 0) == best[g] for g, v in by_group.items())
        assert first is None or sorted(got, key=str) == first
        first = sorted(got, key=str)
    assert simhash.kept(cases.docs(spark, [])).collect() == []
