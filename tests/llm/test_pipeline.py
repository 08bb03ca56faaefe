import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(ROOT, "corpus_pipeline.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def stages(pipeline, spark, docs, folder):
    from netsentry.session import work_dir

    out = []
    for name, stage in pipeline.STAGES:
        path = work_dir(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_each_stage_against_brute_force(pipeline, spark):
    """Stage by stage on what the one before it kept."""
    from test_simhash import brute_classes, brute_fingerprint

    from netsentry.llm.bpe import tokenizer
    from netsentry.llm.catalog import vocabulary

    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    (_, known), (_, single), (_, apart), (_, mixed), (_, tokens) = stages(pipeline, spark, given, folder)
    assert known.columns == single.columns == apart.columns == mixed.columns == given.columns

    kept = known.collect()
    assert len(kept) >= 0.99 * given.count()
    best = {}
    for row in kept:
        best[lower(row.text)] = max(row.doc_id, best.get(lower(row.text), row.doc_id))
    assert sorted(best.values()) == sorted(r.doc_id for r in single.collect())

    pairs = [(brute_fingerprint(r.text), r.doc_id) for r in single.collect()]
    assert sorted(set(brute_classes(pairs).values())) == sorted(r.doc_id for r in apart.collect())

    texts = {r.doc_id: r.text for r in apart.collect()}
    sizes, taken = {}, {}
    for row in apart.collect():
        sizes[row.source] = sizes.get(row.source, 0) + len(row.text.split())
    for row in mixed.collect():
        whole = texts[row.doc_id].split()
        assert len(row.text.split()) <= len(whole) and set(row.text.split()) <= set(whole) and row.n_chars == len(row.text)
        taken[row.source] = taken.get(row.source, 0) + len(row.text.split())
    for source, count in taken.items():
        assert count <= 2 * sizes[source]
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 64 * len(sizes)

    model = tokenizer(vocabulary())
    assert sorted(model.decode(r.ids) for r in tokens.collect()) == sorted(r.text for r in mixed.collect())


def test_hostile_rows(pipeline, spark, hostile, nothing):
    found = stages(pipeline, spark, hostile, "")
    assert {r.doc_id for r in found[0][1].collect()} <= {4, 5, 6, 8, None}
    assert all(docs.columns == hostile.columns for _, docs in found[:-1])
    assert [docs.count() for _, docs in stages(pipeline, spark, nothing, "")] == [0] * 5


def test_run_is_the_last_stage(pipeline, spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns) and rows.count() > 100


def test_run_leaves_settings_and_the_last_table_only(pipeline, spark):
    from netsentry.llm.common import BATCH_SETTING

    base, before = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, "7000")
    made = []
    real = pipeline.work_dir
    pipeline.work_dir = lambda session, name: made.append(real(session, name)) or made[-1]
    try:
        pipeline.run(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(BATCH_SETTING) == "7000"
    finally:
        pipeline.work_dir = real
        spark.conf.set(BATCH_SETTING, before)
    assert [os.path.exists(path) for path in made] == [False] * 4 + [True]
    assert spark.conf.get("spark.checkpoint.dir", None) == base


def test_stages_of_two_threads_do_not_meet(spark):
    from concurrent.futures import ThreadPoolExecutor

    from netsentry.llm.common import stage_tables, stored

    def stage(pool, n):
        def work():
            with stage_tables(spark):
                return stored(spark.range(n), "two-threads")
        return pool.submit(work).result()

    with ThreadPoolExecutor(1) as one, ThreadPoolExecutor(1) as two:
        first = stage(one, 3)
        second = stage(two, 4)
        assert first.count() == 3  # the other pipeline's stage has not deleted it
        path = first.inputFiles()[0]
        third = stage(one, 5)
        assert not os.path.exists(path.removeprefix("file://"))
        assert (second.count(), third.count()) == (4, 5)
