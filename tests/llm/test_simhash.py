import random
import re

import numpy as np
import xxhash

from waymark.llm import simhash as S
from waymark.llm.components import components


def slow(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def union(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def clustered(n, seed=1):
    """Fingerprints with chains, balls and isolated points."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n // 40):
        x = rng.getrandbits(64)
        for _ in range(60):
            out.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    for _ in range(n):
        x = centre
        for _ in range(rng.randrange(0, 5)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def linked(points, radius=3):
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
    return [(points[a], points[b]) for a, b in zip(i, j, strict=True) if a < b]


def stars(v, root):
    return dict(zip(v.tolist(), root.tolist(), strict=True))


def test_fingerprints(odd):
    texts = [r.text for r in odd.collect()] + ["a b", "Aa BB cC dd", "a\x0bb\x0cc\xa0d e f g"]
    assert S.fingerprints(texts).tolist() == [slow(t) for t in texts]


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(S, "SHINGLES", 7)
    t = " ".join(str(k * k % 17) for k in range(100))
    assert S.fingerprints([t, "a b c d", t]).tolist() == [slow(t), slow("a b c d"), slow(t)]


def test_links_span_all_components():
    points = clustered(900)
    want = union(points.tolist(), [(int(a), int(b)) for a, b in linked(points)])
    got = stars(*S.forest(*S.links(points, points[:0])))
    assert {p: got.get(p, p) for p in points.tolist()} == want


def test_shards_lose_no_link():
    points = clustered(700, 2)
    a, b = [], []
    for mask in S.HALVES:
        tree = S.grow(points[::2].copy(), mask, 1, 2.0, 200)
        leaf, at, home = S.deal(points, np.ones(len(points), bool), tree, mask, 1)
        assert sorted(at[home].tolist()) == list(range(len(points))) and leaf.max() > 4
        for k in range(leaf.max() + 1):
            x, y = S.links(points[at[(leaf == k) & home]], points[at[(leaf == k) & ~home]], 3, mask)
            a.append(x), b.append(y)
    got = stars(*S.forest(np.concatenate(a), np.concatenate(b)))
    assert {p: got.get(p, p) for p in points.tolist()} == union(points.tolist(), [(int(x), int(y)) for x, y in linked(points)])


def test_guests_grow_slowly():
    """Rows a random fingerprint in each half's tree of about 12 levels: at most 1.25 a level."""
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 64, 1 << 18, np.uint64)
    tree = S.grow(points, S.HALVES[0], 1, 1.0, 64)
    leaf, _, _ = S.deal(points[:4096], np.ones(4096, bool), tree, S.HALVES[0], 1)
    levels = np.log2(len(tree[1]) + 1)
    assert levels > 11 and len(leaf) / 4096 < 1.25**levels


def test_a_set_that_no_point_splits(monkeypatch):
    monkeypatch.setattr(S, "CELLS", 64)
    base = np.uint64(12345)
    ball = np.array([int(base) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)], np.uint64)
    got = stars(*S.forest(*S.links(ball, ball[:0])))
    assert {p: got.get(p, p) for p in ball.tolist()} == union(ball.tolist(), [(int(x), int(y)) for x, y in linked(ball)])


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 25), (200, 150), (60, 59)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m != 59 else [(k, k + 1) for k in range(59)]
        want = union(range(n), edges)
        got = {r.v: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert {i: got.get(i, i) for i in range(n)} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, odd, none, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 40)
    monkeypatch.setattr(S, "FEWEST", 8)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(30):
        own = rng.choices(words, k=200)
        texts.append(" ".join(own))
        for _ in range(3):
            near = own[:]
            near[rng.randrange(200)] = "changed"
            texts.append(" ".join(near))
    rows = list(enumerate(texts))
    fp = {i: slow(t) for i, t in rows}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    assert len(pairs) > 10
    want = union(fp, pairs)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert S.near_duplicates(none).count() == 0
    found = sorted((r.doc_id, r.component_id) for r in S.near_duplicates(odd).collect() if r.doc_id)
    assert found == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (6, 6), (7, 7), (8, 8), (8, 8)]
    assert [r.component_id for r in S.near_duplicates(odd).collect() if r.doc_id is None] == [1]
