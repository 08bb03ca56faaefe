import random

import numpy as np
import xxhash

from netsentry.llm.components import connected_components
from netsentry.llm.simhash import _merge, fingerprint, link_classes, near_links, one_of_each, simhash_classes


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(pairs):
    """{(fingerprint, id)} -> smallest id reachable."""
    marks = sorted({f for f, _ in pairs})
    points = np.array(marks, np.uint64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    roots = _merge(np.arange(len(points)), *np.nonzero(near))
    least = {}
    for f, i in pairs:
        root = roots[marks.index(f)]
        least[root] = min(least.get(root, i), i)
    return {f: least[roots[marks.index(f)]] for f in marks}


def test_fingerprint():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", " ", "\n", "\x0b", "word", "x y"]) for _ in range(rng.randrange(40)))
        assert fingerprint(text) == brute_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \t") == 0


def test_trees_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    parts = [base]
    for flips in (1, 2, 3, 4):
        points = base.copy()
        for _ in range(flips):
            points ^= np.uint64(1) << rng.integers(0, 64, len(points)).astype(np.uint64)
        parts.append(points)
    crowd = np.full(600, base[0])
    for _ in range(5):
        crowd ^= np.uint64(1) << rng.integers(0, 32, len(crowd)).astype(np.uint64)
    points = np.unique(np.concatenate([*parts, crowd]))
    rng.shuffle(points)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = _merge(np.arange(len(points)), *np.nonzero(near))
    found = np.arange(len(points))
    for half in (0, 1):
        found = _merge(found, np.arange(len(points)), link_classes(points, half))
    assert (found == want).all()


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 500, dtype=np.uint64)
    other = base ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    points = np.unique(np.concatenate((base, other)))
    nodes = spark.createDataFrame([(int(p), k) for k, p in enumerate(points.view(np.int64))], "fingerprint bigint, node bigint")
    edges = near_links(nodes, shard=30).collect()
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    want = _merge(np.arange(len(points)), *np.nonzero(near))
    found = _merge(np.arange(len(points)), np.array([e.a for e in edges]), np.array([e.b for e in edges]))
    assert (found == want).all() and len(set(found)) < len(points)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1001 + k) for k in range(200)]
    edges = [*chain, *star, (7, 7), (None, 3), (500, 400), (400, 500)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(201)} | {400: 400, 500: 400}
    assert found == want


def test_hostile_rows(hostile, nothing):
    rows = simhash_classes(hostile).collect()
    texts = {}
    for row in hostile.collect():
        texts.setdefault(row.doc_id, []).append(fingerprint(row.text))
    pairs = [(f, i) for i, marks in texts.items() for f in marks if i is not None]
    want = brute_classes(pairs)
    assert len(rows) == hostile.count()
    for row in rows:
        mark = row.fingerprint % 2**64
        assert mark in texts[row.doc_id]
        assert row.component_id == want.get(mark)
    assert simhash_classes(nothing).count() == 0


def test_one_of_each_group_stays(hostile, nothing):
    kept = one_of_each(hostile)
    assert kept.columns == hostile.columns
    rows = kept.collect()
    # Empty texts are one class (1), rows 4 and 5 another; rows without id stay.
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 6, 7, 8]
    assert sum(r.doc_id is None for r in rows) == 2
    assert one_of_each(nothing).count() == 0
