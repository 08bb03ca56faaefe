import hashlib
from collections import defaultdict

from netsentry.llm.exact_dedup import CuckooIndex, exact_dedup


def key(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_index_inserts_finds_deletes_and_grows():
    index = CuckooIndex(buckets=1)
    for k in range(5000):
        assert index.get(key(k)) is None
        index.insert(key(k), k)
    assert len(index) == 5000 and index.mask > 1000
    for k in range(0, 5000, 3):
        assert index.delete(key(k)) and not index.delete(key(k))
    for k in range(5000):
        assert index.get(key(k)) == (None if k % 3 == 0 else k)
    assert sorted(value for _, value in index.items()) == [k for k in range(5000) if k % 3]


def test_hit_of_the_filter_is_verified():
    index = CuckooIndex(buckets=1)
    same_tag = key(1)[:2] + b"\x00" * 30
    index.insert(key(1), "one")
    assert index.get(same_tag) is None and not index.delete(same_tag)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[lower(row.text)].append(row.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_hostile_rows(hostile, nothing):
    found = exact_dedup(hostile)
    # `digest` and `Kept` are taken by the input.
    assert {"_digest", "keep_id", "group_size", "_kept"} <= set(found.columns)
    rows, want = found.collect(), brute(hostile.collect())
    assert len(rows) == hostile.count()
    for row in rows:
        assert (row.keep_id, row.group_size) == want[lower(row.text)]
        assert row._digest == hashlib.sha256(lower(row.text).encode()).digest()
    kept = [r for r in rows if r._kept]
    assert sorted(lower(r.text) for r in kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(nothing).count() == 0


def test_many_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('t', id % 700) END AS text")
    rows = exact_dedup(docs.repartition(7), keep_text=False).collect()
    assert sum(r.kept for r in rows) == 1 + 700
    hot = [r for r in rows if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2997, 1000)}


def test_query_equals_sql(spark):
    from compare import database, difference

    from netsentry.llm.catalog import SQL, op5_exact_dedup

    folder = "/root/testdata/sf0.001"
    assert difference(spark, database(folder), op5_exact_dedup, SQL["op5_exact_dedup"], folder) is None


def test_shards_follow_from_the_rows(spark):
    from netsentry.llm.common import stored
    from netsentry.llm.exact_dedup import live_digests

    ids = spark.range(1000).selectExpr("cast(cast(id % 300 as string) as binary) as digest", "id", "id as row")
    found = live_digests(stored(ids, "digests"), shard=10)
    assert found.rdd.getNumPartitions() == 100
    rows = {bytes(r.digest): (r.keep_id, r.keep_row, r.n) for r in found.collect()}
    assert rows == {str(k).encode(): (900 + k if k < 100 else 600 + k, 900 + k if k < 100 else 600 + k, 4 if k < 100 else 3) for k in range(300)}
