"""Columns whose names the operators use inside stay what they are."""

import pytest
from pyspark.sql import functions as F

from netsentry.llm.exact_dedup import exact_dedup
from netsentry.llm.mixing import mix_documents
from netsentry.llm.simhash import one_of_each, simhash_classes

NAMES = (
    "Keep_Row", "keep_id", "row_key", "_row_key", "group_size", "__keep_row", "fingerprint", "component_id", "found_fingerprint",
    "__fingerprint", "row", "of_row", "taken_spans", "taken_texts", "taken_text", "__row", "__spans", "__texts", "__text", "node", "id", "key",
    "size", "shard", "block", "weight", "tokens", "target", "n", "u", "v", "a", "b", "least",
)


@pytest.fixture(scope="module")
def clashing(hostile):
    return hostile.select("*", *(F.lit(f"mine: {n}").alias(n) for n in NAMES))


def unchanged(df):
    rows = df.select(*(f"`{n}`" for n in NAMES)).collect()
    return bool(rows) and all(tuple(row) == tuple(f"mine: {n}" for n in NAMES) for row in rows)


def test_exact_dedup(clashing):
    found = exact_dedup(clashing)
    assert unchanged(found) and found.count() == clashing.count()


def test_simhash(clashing):
    assert unchanged(simhash_classes(clashing)) and simhash_classes(clashing).count() == clashing.count()
    kept = one_of_each(clashing)
    assert unchanged(kept) and kept.columns == clashing.columns


def test_mixing(clashing):
    mixed = mix_documents(clashing)
    assert unchanged(mixed) and mixed.columns == clashing.columns


def test_pipeline_stages(spark, clashing, tmp_path):
    import corpus_pipeline

    docs = clashing
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == clashing.columns and unchanged(docs), name
