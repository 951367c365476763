import random

import numpy as np
import pytest
import xxhash

from tessella.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def brute_fp(text, n=4, k=0):
    words, now = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words, now = (words + [now] if now else words), ""
        else:
            now += ch.lower() if "A" <= ch <= "Z" else ch
    words += [now] if now else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A  b\tc\x0bd É e f " * 300, "x x x x x x"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == [brute_fp(text)]
    assert simhash.fingerprint(text, 5, 3)[0] == brute_fp(text, 5)


def test_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [brute_fp(t) for _, t in docs]
    want = brute_components(fps, 4)
    got = {r.doc_id: r for r in queries.op9_simhash(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (d, _) in enumerate(docs):
        assert got[d].fingerprint == f"{fps[i]:016x}" and got[d].component_id == docs[want[i]][0]


@pytest.mark.parametrize("tile", [4, 20, 4096])
def test_links_lose_nothing(spark, tile):
    """A dense ball of fingerprints, chains, and far ones, over few keys, with tiles far smaller than the groups."""
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, 1, 15, 2**64 - 1}
    for b in base[:3]:
        for _ in range(60):
            fps.add(b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    x = base[4]
    for _ in range(40):  # a long chain
        x ^= sum({1 << rng.randrange(64) for _ in range(4)})
        fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([([simhash._signed(f)],) for f in fps], "fp array<long>")
    edges = simhash.links(df, 4, simhash.pigeonhole_tables(64, 4, 5), tile=tile)
    roots = {r.node[0] % 2**64: r.root[0] % 2**64 for r in simhash.connected_components(edges).collect()}
    for e in edges.collect():
        assert bin(e.a[0] % 2**64 ^ e.b[0] % 2**64).count("1") <= 4 * len(fps)
    want = brute_components(fps, 4)
    ours = [roots.get(f, f) for f in fps]
    same = {}
    for w, o in zip(want, ours):
        assert same.setdefault(w, o) == o
    assert len(set(same.values())) == len(same)


def test_close_pairs():
    rng = np.random.default_rng(5)
    for w, radius in ((1, 0), (1, 4), (1, 7), (4, 40), (1, 64)):
        fps = rng.integers(0, 2**63, (150, w), dtype=np.int64).view(np.uint64)
        fps[75:] = fps[:75] ^ (np.uint64(1) << rng.integers(0, 64, (75, w)).astype(np.uint64))
        planes = simhash._planes(fps)
        items = [(np.repeat(np.arange(150), 3), np.tile(np.arange(3), 150))]
        got = {(int(a), int(b)) for q, c in simhash.close_pairs(fps, planes, iter(items), radius) for a, b in zip(q, c) if b < 150}
        dist = lambda a, b: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(fps[a], fps[b]))
        assert got == {(a, b) for a in range(150) for b in range(150) if dist(a, b) <= radius}


@pytest.mark.parametrize("large", [3, 512])
def test_large_groups(spark, monkeypatch, large):
    """Groups over several words and both ways of comparing give the components of brute force."""
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "LARGE_STEP", 7)
    rng = np.random.default_rng(large)
    fps = rng.integers(0, 2**63, (700, 2), dtype=np.int64).view(np.uint64)
    for i in range(1, 650):  # trees of near copies, and a third without any
        if i % 3:
            fps[i] = fps[rng.integers(0, i)]
            for b in rng.integers(0, 128, 5):
                fps[i, b // 64] ^= np.uint64(1 << int(b % 64))
    whole = [int(a) << 64 | int(b) for a, b in fps]
    want = brute_components(whole, 8)
    keys, none = np.zeros(700, np.int64), np.full(700, -1, np.int8)
    assert simhash._groups(fps, keys, none, none, 8).tolist() == want
    half = (np.arange(700) >= 300).astype(np.int8)
    both = simhash._groups(fps, keys, half, np.ones(700, np.int8), 8)
    pairs = simhash._Union(700)
    for i in range(300):
        for j in range(300, 700):
            if bin(whole[i] ^ whole[j]).count("1") <= 8:
                pairs.add(np.array([i]), np.array([j]))
    assert both.tolist() == pairs.root.tolist()


def test_keep_one(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choices(words, k=300) for _ in range(30)]
    rows = []
    for i in range(200):
        text = list(base[i % 30])
        for _ in range(rng.randrange(4)):  # at most 15 of 296 shingles change on either side
            text[rng.randrange(300)] = "changed"
        rows.append((1000 - i, " ".join(text), i % 30))
    rows += [(None, None, None), (None, "", None), (5000, rows[0][1], 0), (5000, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root long")
    kept = simhash.keep_one(df).collect()
    assert sorted(r.root for r in kept if r.root is not None) == list(range(30))
    assert len(kept) == 31 and kept[0].__fields__ == df.columns
    assert all(r.doc_id == min(x[0] for x in rows[:200] if x[2] == r.root) for r in kept if r.root is not None)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_edges(spark):
    df = spark.createDataFrame(
        [(7, None, "a"), (3, "", "b"), (None, " ", "c"), (5, "same text here now", "d"), (5, "same text here now", "d"), (9, "b " * 100_000, "e")],
        "doc_id long, text string, component_id string",
    )
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.groups(df).collect())
    assert got == [(-1, 3), (3, 3), (5, 5), (5, 5), (7, 3), (9, 9)]
    assert simhash.groups(df.limit(0)).count() == 0
    assert simhash.groups(df.where("doc_id is null")).collect()[0].component_id is None
