import hashlib
import random
import re

import numpy as np
import pytest

from netsentry.llm import phrases as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    key = lambda doc, place: (doc is None, doc or 0, place)
    first, out = {}, []
    for doc, text in docs:
        words = WORD.findall(text or "")
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            first[window] = min(key(doc, p), first.get(window, key(doc, p)))
    for doc, text in docs:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            if first[tuple(words[p : p + 20])] < key(doc, p):
                gone[p : p + 20] = [True] * 20
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def documents(seed):
    rng = random.Random(seed)
    words = ["the", "of", "é", "日本", "a", "bb", "x"]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(5)]
    docs = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(4)):
            source, start = rng.choice(base), rng.randrange(130)
            parts += source[start : start + rng.randrange(15, 80)] + [rng.choice("pqrs") for _ in range(rng.randrange(8))]
        docs.append((rng.choice([None, *range(60)]), "".join(w + rng.choice([" ", " ", "\n", " \t"]) for w in parts) or None))
    docs += [(100, "a " * 300), (101, "a " * 120), (102, " ab" * 100), (103, "b a " * 60), (104, None), (105, "x " * 19)]
    return docs + [(106, "x " * 20), (107, "x " * 21), (None, "a b " * 30), (108, "no break word " * 50)]


@pytest.mark.parametrize("hot, pack_bytes, shard", [(2048, 1 << 22, 12_000), (2048, 700, 50), (3, 700, 20)])
def test_equals_brute_force(spark, hot, pack_bytes, shard):
    docs = documents(hot + pack_bytes)
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = P.remove_phrases(rows, full=False, hot=hot, pack_bytes=pack_bytes, shard_passages=shard).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs)


def test_two_characters_a_word():
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(600)]
    texts = [" ".join(base[k : k + rng.randrange(20, 33)]).encode() for k in (rng.randrange(500) for _ in range(300))]
    ids, places, anchors = np.arange(300) % 7, np.arange(300), [3] * 300
    one, two = (P.later_windows(texts, ids, places, anchors, plane) for plane in (P.PLANE, 100))
    assert P.coded(texts)[1] == 1 and P.coded(texts, 100)[1] == 2
    assert (one == two).all() and one.any()


def test_characters_are_different_and_legal():
    lines, width = P.coded([b" ".join(b"%d" % k for k in range(0xE000))])
    assert width == 1 and len(set(lines[0])) == 0xE000
    lines[0].encode()


def test_one_very_long_document(spark):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    docs = [(1, long), (2, "start " + long[70_000:90_000]), (3, "other words")]
    found = P.remove_phrases(spark.createDataFrame(docs, "doc_id bigint, text string"), full=False).collect()
    assert sorted(map(tuple, found), key=str) == brute(docs)


def test_full_result(spark):
    passage = " ".join(f"word{k}" for k in range(25))
    docs = spark.createDataFrame([(1, "one\n" + passage), (2, passage.replace(" ", "  ") + " two"), (3, passage[:80])], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in P.remove_phrases(docs).collect()}
    assert rows[2].kept == "two" and [(s.start, s.stop) for s in rows[2].spans] == [(0, 25)]
    assert rows[1].n_removed == rows[3].n_removed == 0


def test_hostile_rows(hostile, nothing):
    rows = P.remove_phrases(hostile, full=False).collect()
    assert sorted(map(tuple, rows), key=str) == brute([(r.doc_id, r.text) for r in hostile.collect()])
    assert P.remove_phrases(nothing).count() == 0


def test_query_equals_sql(spark):
    from compare import database, difference

    from netsentry.llm.catalog import SQL, op13_phrases

    folder = "/root/testdata/sf0.001"
    assert difference(spark, database(folder), op13_phrases, SQL["op13_phrases"], folder) is None
