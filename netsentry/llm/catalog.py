"""The queries of the operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.llm import language, statements, toxicity
from netsentry.llm.bpe import encode_documents
from netsentry.llm.common import table
from netsentry.llm.exact_dedup import exact_dedup
from netsentry.llm.merkle import audited
from netsentry.llm.mixing import mix_counts
from netsentry.llm.phrases import remove_phrases
from netsentry.llm.pii import find_pii
from netsentry.llm.prefix_trie import prefix_trie, rebuilt, turn_rows
from netsentry.llm.quality import quality
from netsentry.llm.simhash import simhash_classes
from netsentry.llm.suffix_dedup import remove_repeats
from netsentry.llm.warc import pages_through_archives

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The vocabulary file of the tokenizer query; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return quality(table(spark, folder, "documents")).select(*columns)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_counts(table(spark, folder, "documents"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find_pii(table(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents").select("doc_id", "text"), vocabulary(), full=False)


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep_text=False).select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = language.language(docs, language.learn(docs))
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = toxicity.toxicity(docs, toxicity.learn(docs, table(spark, folder, "labels")))
    return judged.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return pages_through_archives(table(spark, folder, "pages"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), full=False)


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return audited(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(*rebuilt(turn_rows(table(spark, folder, "conversations"))))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return remove_phrases(table(spark, folder, "documents").select("doc_id", "text"), full=False)


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle": op11_merkle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT r, coalesce(doc_id, 9223372036854775807) AS id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d),
        s AS (SELECT r, id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
        gone AS (SELECT r, p FROM (SELECT r, p, id, min(id) OVER (PARTITION BY s) AS owner FROM s) WHERE owner < id),
        runs AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM (
            SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone)),
        spans AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY r, run),
        pieces AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_ FROM spans),
        kept AS (SELECT d.r, any_value(d.doc_id) AS doc_id, any_value(d.h) AS h, coalesce(sum(b - a), 0) AS n_removed, count(a) AS n_spans,
                   coalesce(string_agg(substr(d.h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a), '') AS before,
                   coalesce(max(b), 0) AS tail
                 FROM d LEFT JOIN pieces ON d.r = pieces.r GROUP BY d.r)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
               sha256(unhex(before || substr(h, 2 * tail + 1))) AS kept_sha256
        FROM kept""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes,
                     -- Base 32: five bits at a time, out of the two hex digits they lie in.
                     array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                         ((CAST('0x' || substr(hex, (5 * i) // 4 + 1, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '')
                         AS payload_digest,
                     min(page_id) OVER (PARTITION BY html) AS first
              FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
    "op11_merkle": statements.MERKLE,
    "op12_prefix_trie": statements.TRIE,
    "op13_phrases": statements.PHRASES,
}
