import hashlib
import random

import numpy as np
import pytest

from netsentry.llm import suffix_dedup as S


def brute(docs):
    first = {}
    order = lambda key: S.NO_ID if key is None else key
    for key, text in docs:
        raw = (text or "").encode()
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(order(key), first.get(raw[k : k + 50], S.NO_ID))
    out = []
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < order(key):
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(byte for byte, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((key, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def documents(seed):
    rng = random.Random(seed)
    words = ["the", "of", "alpha", "beta", "gamma", "\x00", "é", "aaaa", "ab", "x"]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            source = rng.choice(base)
            start = rng.randrange(len(source))
            parts += [source[start : start + rng.randrange(20, 200)], "".join(rng.choice("abcdefgh \x00") for _ in range(rng.randrange(30)))]
        docs.append((rng.choice([None, *range(50)]), "".join(parts) or None))
    docs += [(100, "a" * 300), (101, "a" * 120), (102, "ab" * 100), (103, "ba" * 60), (104, None), (105, "x" * 49), (106, "x" * 50), (107, "x" * 51)]
    return docs


# The last two have more buckets than ranges, and one bucket for each few suffixes.
@pytest.mark.parametrize(
    "hot_packs, pack_bytes, bucket, max_ranges",
    [(512, 1 << 21, S.BUCKET, S.MAX_RANGES), (2, 500, S.BUCKET, S.MAX_RANGES), (512, 500, 20, S.MAX_RANGES), (3, 700, 15, 4)],
)
def test_equals_brute_force(spark, monkeypatch, hot_packs, pack_bytes, bucket, max_ranges):
    monkeypatch.setattr(S, "SAMPLED", 2)
    docs = documents(hot_packs)
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    settings = {"hot_packs": hot_packs, "pack_bytes": pack_bytes, "bucket": bucket, "max_ranges": max_ranges}
    found = S.remove_repeats(rows, full=False, **settings).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs)


def test_line_in_every_document(spark):
    line = "a line that very many documents of this table have in common, word for word\n"
    docs = [(k, f"{k * 7919} {'y' * (k % 13)}\n{line}{k * 104729} tail") for k in range(400)]
    found = S.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8), hot_packs=3, pack_bytes=2_000)
    assert sorted(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == brute(docs)


def test_multikey_order():
    rng = np.random.default_rng(1)
    for width in (1, 7, 8, 20):
        records = rng.integers(0, 3, (500, width), dtype=np.uint8)
        order = S.multikey_order(records)
        rows = [bytes(r) for r in records]
        assert [rows[k] for k in order] == sorted(rows)
        above = rng.integers(0, 4, 500)
        order = S.multikey_order(records, above)
        assert [(above[k], rows[k]) for k in order] == sorted(zip(above, rows))
        shared = S.common_prefix(records[order])
        for place in range(1, 500):
            a, b = rows[order[place - 1]], rows[order[place]]
            assert shared[place] == next((k for k in range(width) if a[k] != b[k]), width)


def test_anchors_depend_on_the_window_only():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 2000, dtype=np.uint8)
    anchors = S.window_anchors(S.gram_hashes(raw))
    assert len(anchors) == len(raw) - S.LENGTH + 1
    for start in range(0, len(anchors), 37):
        alone = S.window_anchors(S.gram_hashes(raw[start : start + S.LENGTH]))
        assert list(alone + start) == [anchors[start]]


def test_suffixes_with_equal_first_bytes_are_cut(spark):
    rng = np.random.default_rng(3)
    records = rng.integers(97, 123, (40_000, S.RECORD), dtype=np.uint8)
    records[:, :8] = np.frombuffer(b" the the", np.uint8)
    records[:4_000, 8 : S.GRAM] = ord("a")  # one gram with many suffixes, which no splitter may cut
    sample = records[rng.permutation(len(records))[:4_000], : S.GRAM]
    blobs = spark.createDataFrame([(bytearray(part.tobytes()),) for part in np.split(sample, 40)], "leads binary").repartition(5)
    cuts = S.splitters(blobs, 20)
    leads = sorted(bytes(r) for r in sample)
    assert cuts == sorted({leads[-(-k * len(leads) // 20)] for k in range(1, 20)})
    bucket = S.Route(1, tuple(cuts), 1, 1).suffix_bucket(records)
    assert list(bucket) == [sum(c <= bytes(r[: S.GRAM]) for c in cuts) for r in records]
    assert len(set(bucket[:4_000])) == 1 and np.bincount(bucket[4_000:]).max() <= 2 * len(records) / 20
    several = S.Route(1, tuple(cuts), 3, 1).suffix_bucket(records)
    assert (several // 3 == bucket).all() and len(set(several[:4_000])) == 1
    assert np.bincount(several[4_000:]).max() <= 2 * len(records) / 60


def test_pieces_do_not_change_anchors(monkeypatch):
    texts = [(text or "").encode() for _, text in documents(5)]
    row = {
        "ids": np.arange(len(texts)).tobytes(), "sizes": np.array([len(t) for t in texts]).tobytes(),
        "blob": S.zstandard.compress(b"".join(texts)),
    }
    whole = S.Pack(row)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(S, "PIECE", size)
        pieces = S.Pack(row)
        for name in ("anchors", "owner", "first", "last", "keys"):
            assert (getattr(whole, name) == getattr(pieces, name)).all()


def test_full_result(spark):
    passage = "A passage of more than fifty bytes that two documents have in common, as it happens."
    docs = spark.createDataFrame([(1, "one " + passage), (2, passage + " two"), (3, "other")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    assert bytes(rows[2].kept) == b" two" and [(s.start, s.stop) for s in rows[2].spans] == [(0, len(passage))]
    assert rows[1].n_removed == rows[3].n_removed == 0


def test_hostile_rows(hostile, nothing):
    rows = S.remove_repeats(hostile, full=False).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r.doc_id, r.text) for r in hostile.collect()])
    assert S.remove_repeats(nothing).count() == 0


def test_query_equals_sql(spark):
    from compare import database, difference

    from netsentry.llm.catalog import SQL, op10_suffix_dedup

    folder = "/root/testdata/sf0.001"
    assert difference(spark, database(folder), op10_suffix_dedup, SQL["op10_suffix_dedup"], folder) is None
