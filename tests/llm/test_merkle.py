import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netsentry.llm import merkle as M
from netsentry.llm.ranks import ranked


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(value(v) for v in (doc_id, source, lang, n_chars, text)))


def levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def steps(tree, place, arity):
    for level in tree[:-1]:
        first = place - place % arity
        yield level[first:place], level[place + 1 : first + arity]
        place //= arity


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def brute(rows, arity=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row), row))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda g: g[:3])
        trees[lang] = levels([g[2] for g in groups[lang]], arity)
    top = levels([trees[lang][-1][0] for lang in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        for place, (_, _, own, row) in enumerate(groups[lang]):
            path = [*steps(trees[lang], place, arity), *steps(top, k, arity)]
            folded = leaf(*row[:4], row[4] + 1) if tampered(row[0]) and row[4] is not None else own
            for before, after in path:
                folded = sha(*before, folded, *after)
            proof = sha(*(d for before, after in path for d in before + after))
            out.append((row[0], own, trees[lang][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def audit(df, **kwargs):
    spoiled = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return sorted(map(tuple, M.audited(df, spoiled, **kwargs).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"text {k}", [None, "", "en", "en", "en", "é", "z"][k * k % 7], "s" if k % 3 else None, k if k % 5 else None) for k in range(90)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)


@pytest.mark.parametrize("arity, digits", [(2, 10), (2, 2), (3, 1), (5, 2)])
def test_equals_brute_force(docs, arity, digits):
    found = audit(docs, arity=arity, digits=digits)
    assert found == brute([tuple(r) for r in docs.collect()], arity)
    assert {row[-1] for row in found} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5, 8, 9])
def test_ragged_trees(spark, count):
    rows = [(k, "t", "en", None, 7) for k in range(count)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert audit(df, digits=1) == brute(rows)


def test_hostile_rows(hostile):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in hostile.collect()]
    assert audit(hostile, digits=2) == brute(rows)


def test_many_groups(spark):
    rows = [(k, "t", f"l{k % 40:02}", None, k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert audit(df, digits=2) == brute(rows)


def test_largest_count_can_be_tampered(spark):
    key = next(k for k in range(100) if tampered(k))
    df = spark.createDataFrame([(key, "t", "en", None, 2**63 - 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert audit(df)[0][-1] is False


def test_proofs_need_no_join(docs):
    joins = [line for line in plan_of(docs) if "Join" in line]
    assert not joins


def plan_of(docs):
    spoiled = F.lit(False)
    return M.audited(docs, spoiled)._jdf.queryExecution().executedPlan().toString().splitlines()


def test_ranked(spark):
    rows = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("o"), "id").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    found = ranked(rows, ["g"], ["o", "id"]).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in found if r.g == g), key=lambda r: (r.o, r.id))
        assert [r["rank"] for r in own] == list(range(len(own))) and {r["size"] for r in own} == {len(own)}


def test_query_equals_sql(spark):
    from compare import database, difference

    from netsentry.llm.catalog import SQL, op11_merkle

    folder = "/root/testdata/sf0.001"
    assert difference(spark, database(folder), op11_merkle, SQL["op11_merkle"], folder) is None
