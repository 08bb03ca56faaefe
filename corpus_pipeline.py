"""The corpus pipeline: language identification, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is stored in the shared folder and read back as the
next one's documents. All but the last give the columns of `documents`. A stage begins by deleting the intermediate tables
of the one before it in the same thread, whose result has been written by then, so that the disk holds those of one stage
at a time. Pipelines may run at once in several threads.

For every stage: extra columns pass through unchanged, whatever their names, since helper columns take free ones. Texts are
taken whole at any length. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.llm import language
from netsentry.llm.bpe import encode_documents
from netsentry.llm.catalog import vocabulary
from netsentry.llm.common import settings_kept, stage_tables, table
from netsentry.llm.exact_dedup import exact_dedup
from netsentry.llm.mixing import mix_documents
from netsentry.llm.simhash import one_of_each
from netsentry.plans.store import delete_folder
from netsentry.session import work_dir

LEAST_SCORE = 0.3  # probability below which no language is accepted


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network is fairly sure of; those without letters go. A missing `lang` is filled.

    Null and empty texts have no letter and go. Repeated rows are judged alike and all stay or all go; a null id or source
    plays no part.
    """
    with stage_tables(spark):
        judged = language.language(docs, language.learn(docs))
        sure = judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
        return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that differ at most in the case of A-Z: that with the largest id.

    Null text equals empty text. A row without id stays only where its class has no other; of rows that share text and id
    one stays.
    """
    with stage_tables(spark):
        return exact_dedup(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints: that with the smallest id.

    Null and empty texts, and texts of separators, have fingerprint 0 and are one class with what is near it. Rows without id
    all stay; of rows that share id and class one stays.
    """
    with stage_tables(spark):
        return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of tokens that the mix takes of each document; a document taken twice comes twice.

    A null source is a source like any other, the last one. Documents without words, null texts included, have size 0; of
    them nothing is taken, and they do not come back. Repeated rows are documents of their own. Ties between quotients and
    between blocks have a fixed order, so a rerun takes the same.
    """
    with stage_tables(spark):
        return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hash of the text that they decode to.

    Null text is empty text, which has no tokens. Each row gives one row, repeated ones and rows without id, too.
    """
    with stage_tables(spark):
        return encode_documents(docs, vocabulary()).drop("decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's table is deleted once the next one's is written; the last one stays, it is
    what the result reads. The session's settings are afterwards what they were before."""
    docs, before = table(spark, sf_dir, "documents"), None
    with settings_kept(spark):
        for name, stage in STAGES:
            path = work_dir(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete_folder(spark, before)
            before = path
        with stage_tables(spark):
            return docs
