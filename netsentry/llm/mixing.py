"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a target number of tokens: its weight's share of the whole, at most `cap` times what it has, what is
too much shared anew by weight. Targets become whole numbers of blocks of `block` tokens by the highest quotients
target / (2 s + 1), s the blocks that the source has got so far; each source's blocks are apportioned in the same way to its shards, by their size. A shard lines
up its documents' tokens, cuts the line into blocks and takes each block quota // blocks times, and the first blocks in
a seeded order once more. Shards hold about `shard_tokens` tokens, so a source with a third of all rows is cut into
many, and no step needs a source in one task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netsentry.llm.common import SPACE, free_name, stored
from netsentry.llm.ranks import ranked

BLOCK, SHARD_TOKENS = 64, 1_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    """Words of the text, null as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("bigint")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """`weight` of each row: the weights in turn, by source in code-point order, null last. One row per source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds `target` to rows (`source`, `tokens`, `weight`): `share` of all tokens by weight, at most cap * tokens.

    A source is at its cap when the level (tokens per weight) at which the others share the rest is above its own
    ratio of cap to weight. Ratios are taken in ascending order; the first that the level reached there does not exceed
    ends the capped ones. Rows are sources, not documents.
    """
    limit = F.col("tokens") * cap
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    capped = F.col("first").isNull() | (F.col("place") < F.col("first"))
    return (
        sources.withColumn("limit", limit)
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("total", F.least(F.sum("tokens").over(whole) * share, F.sum("limit").over(whole)))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", level)
        .withColumn("place", F.row_number().over(order))
        .withColumn("first", F.min(F.when(F.col("level") < F.col("ratio"), F.col("place"))).over(whole))
        .withColumn("end", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(whole))
        .withColumn("target", F.when(capped, F.col("limit")).otherwise(F.col("weight") * F.col("end")))
        .drop("limit", "ratio", "total", "weights", "level", "place", "first", "end")
    )


def sainte_lague(rows: DataFrame, group: list[str], weight: str, seats: Column, most: Column, order: list[str]) -> DataFrame:
    """Adds `seats` to each row: `seats` of its group by the highest quotients weight / (2 s + 1), at most `most` each.

    With n rows and W their weight, floor(w * (seats - n / 2) / W + 1/2) seats are sure, and none gets more than
    ceil(w * (seats + n / 2) / W + 1/2). Only the quotients in between, about 2 n for the group, are ranked. Ties go by
    `order`. Rows of weight 0 get none. Quotients beyond `most` do not compete.

    Sums are aggregates that meet the rows again in a join, and quotients are ranked by a range sort, so a group of any
    number of rows is spread over all tasks. Groups themselves are few.
    """

    def with_totals(left: DataFrame, totals: DataFrame) -> DataFrame:
        named = totals.select(*(F.col(c).alias(f"__of_{c}") for c in group), *(c for c in totals.columns if c not in group))
        same = F.lit(True)
        for c in group:
            same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
        return left.join(named, same).drop(*(f"__of_{c}" for c in group))

    weighed = rows.withColumn("__w", F.col(weight).cast("double")).withColumn("__most", most.cast("bigint")).withColumn("__all", seats.cast("double"))
    sums = weighed.groupBy(*group).agg(F.sum("__w").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    per = F.col("__w") / F.when(F.col("__sum") > 0, F.col("__sum")).otherwise(1.0)
    bound = lambda seats: F.greatest(F.lit(0.0), F.floor(per * seats + 0.5))
    near = stored(
        with_totals(weighed, sums)
        .withColumn("__low", F.least(F.col("__most"), bound(F.col("__all") - F.col("__n") / 2).cast("bigint")))
        .withColumn("__high", F.least(F.col("__most"), (bound(F.col("__all") + F.col("__n") / 2) + 1).cast("bigint"))),
        "mix-near",
    )
    sure = near.groupBy(*group).agg(F.sum("__low").alias("__sure"))
    several = (F.col("__w") > 0) & (F.col("__high") > F.col("__low"))
    none = F.array(F.lit(-1).cast("bigint"))
    wanted = near.withColumn("__seat", F.explode(F.when(several, F.sequence("__low", F.col("__high") - 1)).otherwise(none)))
    falling = F.when(F.col("__seat") >= 0, -F.col("__w") / (2 * F.col("__seat") + 1)).otherwise(1.0)
    placed = with_totals(ranked(wanted.withColumn("__falling", falling), group, ["__falling", *order], "__rank", "__rows"), sure)
    taken = (F.col("__rank") < F.col("__all") - F.col("__sure")) & (F.col("__seat") >= 0)
    got = placed.withColumn("__got", taken.cast("bigint"))
    return got.groupBy(*rows.columns).agg((F.max("__low") + F.sum("__got")).alias("seats"))


def mix_spans(
    docs: DataFrame, weigh, share: float = 1.5, cap: float = 2.0, seed: int = 42, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """Which tokens of which documents the mix takes.

    `docs` has `row` (a unique number), `key` (what the seeded order goes by), `source` and `size` (tokens). `weigh` adds `weight` to rows (`source`, `tokens`).
    Gives the sources with `target`, and rows (`row`, `first`, `last`, `times`): tokens first to last - 1 of the document,
    counted from 0, are taken `times` times. Documents without tokens take no part.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("tokens"))
    sources = stored(targets(weigh(sources), share, cap), "mix-sources")

    # Shards: documents by hash of their key. Their number follows from the source's size.
    count = F.greatest(F.lit(1), F.ceil(F.col("tokens") / shard_tokens)).cast("bigint")
    dealt = (
        docs.filter("size > 0")
        .join(sources.select(F.col("source").alias("__source"), count.alias("__shards")), F.col("source").eqNullSafe(F.col("__source")))
        .select("row", "key", "source", "size", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("__shards")).alias("shard"))
    )
    line = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key", "row")
    lined = stored(
        dealt.withColumn("stop", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size")),
        "mix-lines",
    )
    shards = lined.groupBy("source", "shard").agg(F.max("stop").alias("tokens")).withColumn("blocks", F.ceil(F.col("tokens") / block))

    seats = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.sum("tokens").alias("tokens"))
    named = sources.select(F.col("source").alias("__source"), "target", "weight")
    seats = seats.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # Blocks at a shard's end are short: targets in blocks count by the mean size of the source's blocks.
    seats = seats.withColumn("wanted", F.col("target") * F.col("blocks") / F.col("tokens"))
    at_cap = F.col("target") >= cap * F.col("tokens")
    most = F.round(cap * F.col("blocks"))
    seats = seats.withColumn("at_cap", at_cap).withColumn("quota", F.when(at_cap, most))
    # Stored, as joins on a column known to be constant would become nested loops.
    below = stored(seats.filter("not at_cap").withColumn("one", F.lit(1)), "mix-seats")
    free = sainte_lague(
        below, ["one"], "wanted", F.round(F.sum("wanted").over(W.partitionBy("one"))), most, ["source"],
    ).select("source", F.col("seats").alias("quota"))
    quotas = stored(free.unionByName(seats.filter("at_cap").select("source", F.col("quota").cast("bigint"))), "mix-quotas")

    quotas = quotas.select(F.col("source").alias("__source"), "quota")
    shards = shards.join(quotas, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    shards = sainte_lague(shards, ["source"], "blocks", F.col("quota"), F.round(cap * F.col("blocks")), ["shard"])
    shards = stored(shards.select("source", "shard", "blocks", "seats"), "mix-shards")

    # Blocks in seeded order: the first seats % blocks of them are taken once more than the others.
    each = shards.select("source", "shard", "blocks", "seats", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block")
    each = each.withColumn("rank", F.row_number().over(order)).select(
        F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.col("block").alias("__block"),
        (F.floor(F.col("seats") / F.col("blocks")) + (F.col("rank") <= F.col("seats") % F.col("blocks")).cast("bigint")).alias("times"),
    )
    pieces = lined.select(
        "row", "source", "shard", "start", "stop",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("block"),
    )
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard")) & (F.col("block") == F.col("__block"))
    # The block table grows with the input, and its size is underestimated behind the generator: never broadcast.
    spans = pieces.join(each.filter("times > 0").hint("merge"), same).select(
        "row",
        (F.greatest("start", F.col("block") * block) - F.col("start")).alias("first"),
        (F.least("stop", (F.col("block") + 1) * block) - F.col("start")).alias("last"),
        "times",
    )
    return sources, spans


def mix_counts(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 42, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Per document: `doc_id`, `size`, `source_size`, `target` (its source's), `taken` (words taken, repeats counted).

    Null texts have size 0, a null source is a source of its own (the last), documents without words take nothing, equal
    rows are documents of their own. Empty tables give no rows. A rerun over the same rows takes the same words.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = stored(keyed(sized), "mix-sizes")
    sources, spans = mix_spans(sized, lambda rows: cyclic_weights(rows, weights), share, cap, seed, shard_tokens=shard_tokens)
    taken = spans.groupBy("row").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
    sources = sources.select(F.col("source").alias("__source"), F.col("tokens").alias("source_size"), "target")
    return (
        sized.join(sources, F.col("source").eqNullSafe(F.col("__source")))
        .join(taken, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def keyed(sized: DataFrame) -> DataFrame:
    """Adds `row`, a number to join by (store the result before it is read twice), and `key`, a hash of id, source and size,
    by which shards and orders are drawn: it does not depend on how the rows lie in files."""
    return sized.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("doc_id", "source", "size"))

def cut_text(text: str, spans: list[tuple[int, int, int]], number: int) -> str:
    """What the mix takes of a text in its `number`-th pass over it: runs of words with the white space between them,
    joined by line feeds. A pass that takes all words takes the text as it is."""
    runs: list[list[int]] = []
    for first, last, times in sorted(spans):
        if times >= number:
            if runs and runs[-1][1] == first:
                runs[-1][1] = last
            else:
                runs.append([first, last])
    words = [m.span() for m in WORD.finditer(text)]
    if runs == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


def mix_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 42) -> DataFrame:
    """The mix itself: rows of `docs` (`doc_id`, `text`, `source`, others), one for each pass in which the document has
    taken words, with the text cut to them (and `n_chars` to its length, where there is such a column).

    Null and empty texts have no words and are never taken; a null source is one of its own, the last. Equal rows are
    separate documents that are taken alike; a text of any length is cut at blocks of words and lies in one shard. An
    empty table gives no rows. Other columns stay as they are, whatever their names.
    """
    row, taken, texts, one = (free_name(docs, n) for n in ("row", "taken_spans", "taken_texts", "taken_text"))
    of_row = free_name(docs, "of_row")
    keyed_docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    sized = keyed_docs.select(
        F.col(row).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64("doc_id", F.col("source").cast("string"), word_count(F.col("text").cast("string"))).alias("key"),
    )
    _, spans = mix_spans(stored(sized, "mix-sizes"), lambda rows: cyclic_weights(rows, weights), share, cap, seed)
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("first", "last", "times")).alias(taken))

    def cut(text: pa.Array, taken: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([], kind)]
        for at in range(0, len(text), 200):  # so that few texts are held more than once
            out = []
            for value, rows in zip(text.slice(at, 200).to_pylist(), taken.slice(at, 200).to_pylist()):
                spans = [(r["first"], r["last"], r["times"]) for r in rows]
                out.append([cut_text(value, spans, k) for k in range(1, max(s[2] for s in spans) + 1)])
            parts.append(pa.array(out, kind))
        return pa.concat_arrays(parts)

    # Marked so that the filter that Spark derives from the explosion does not cut a second time, in a second worker of the task.
    cut_once = F.arrow_udf(cut, "array<string>").asNondeterministic()
    parts = cut_once(F.col("text").cast("string"), F.col(taken))
    mixed = keyed_docs.join(spans.withColumnRenamed("row", of_row), F.col(row) == F.col(of_row))
    mixed = mixed.withColumn(texts, parts).withColumn(one, F.explode(texts)).withColumn("text", F.col(one))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return mixed.select(*docs.columns)
