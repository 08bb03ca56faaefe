"""The trie of conversation prefixes by ROLLUP over columns of turn ids.

A turn's id is a 128-bit digest of its role and text. A conversation is a row of COLUMNS turn-id columns; one
`GROUP BY ..., ROLLUP(t1, ..., t8)` aggregates all its prefixes together, and `grouping_id()` tells a prefix's length.
A longer conversation goes on in further rows, whose group key is the node that the row before it ends in: a digest of
all turns before. Those digests are chained within segments of SEGMENT turns, each on its own, and then over the
segments of a conversation, so that a conversation with most of the turns is spread like any other.

Totals over subtrees need no walk through the tree. A node belongs to its smallest member, its owner, and whoever owns a
node owns all of its nodes below. So a conversation c has one depth from which on it owns its nodes, and A(c), the words
of its turns before that depth, are those that it shares with smaller conversations. Below and at a node, the words of
repeated turns are the sum of A over its members other than its owner, less the words above the node for each of them;
and the leaves are the members that own their last node where nothing follows. Both are sums over members, which a
second ROLLUP over the same rows gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import stored
from netsentry.llm.mixing import word_count
from netsentry.llm.ranks import ranked

COLUMNS, SEGMENT = 8, 1024  # turn-id columns of a row; turns whose digests are chained in one row
CHUNK = 4096  # conversation ids of one node that are joined into one text before they are hashed
TURNS = [f"t{k}" for k in range(1, COLUMNS + 1)]
ROOT = b"\0" * 16


def _id(value: Column) -> Column:
    """16 bytes of a digest."""
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(`conv_id`, `place`, `size`, `turn_id`, `words`) of rows (`conv_id`, `turn`, `role`, `text`), stored.

    Turns of a conversation are in the order of `turn`, null first, equal ones by the digest of role and text; `place`
    counts from 0, `size` are the turns of the conversation. Null role or text counts as empty. Rows without `conv_id`
    belong to no conversation and are left out; other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), "turn", _id(whole.cast("binary")).alias("turn_id"), word_count(text).alias("words")
    )
    found = ranked(rows, ["conv_id"], ["turn", "turn_id"], rank="place", size="size")
    return stored(found.drop("turn"), "turns")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one: the first h turns of conversation c - c % `every` (all if it has fewer,
    none if it is absent), then c's own after its first h, h = crc32(c as text) % `heads`.

    Gives (`conv_id`, `length`, `place`, `turn_id`, `words`) and one row (`conv_id`, `length`) per conversation, also for
    those that have no turn left.
    """
    fields = F.struct("place", "turn_id", "words")
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < heads - 1)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.array_sort(F.collect_list(fields)).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.filter("place = 0").select("conv_id", "size", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    own = own.join(first, "base", "left")
    head = F.when(F.col("head").isNull(), F.array().cast("array<struct<place: bigint, turn_id: binary, words: bigint>>"))
    own = own.withColumn("head", head.otherwise(F.slice("head", 1, F.col("h"))))
    own = own.withColumn("length", F.size("head") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    own = stored(own, "heads")
    begun = own.select("conv_id", "length", F.inline("head"))
    # A conversation with most of the turns meets one row here; adaptive execution splits its side.
    later = turns.join(own.select("conv_id", "length", "h", F.size("head").alias("begun")), "conv_id").filter("place >= h")
    later = later.select("conv_id", "length", (F.col("place") - F.col("h") + F.col("begun")).alias("place"), "turn_id", "words")
    return begun.unionByName(later), own.select("conv_id", "length")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(`conv_id`, `segment`, `start`, `words_before`) from (`conv_id`, `segment`, `last`, `words`) in order."""
    at, key, words = None, b"", 0
    for batch in batches:
        rows = []
        for conv, segment, last, own in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != at:
                at, key, words = conv, ROOT, 0
            rows.append((conv, segment, key, words))
            key, words = hashlib.sha256(key + last).digest()[:16], words + own
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["conv_id", "segment", "start", "words_before"]
        )


def turn_blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(`conv_id`, `length`, `block`, `key`, `next`, `before`, `words`, `t1`, ...): COLUMNS turns a row, stored.

    `key` is the node that the rows before end in, `next` the one that this row ends in if it is full, `before` the words
    of the turns before it. A conversation without turns has one row without turn ids.
    """
    turn = F.struct("place", "turn_id", "words")
    segments = turns.groupBy("conv_id", "length", F.expr(f"place div {SEGMENT}").alias("segment"))
    segments = segments.agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / COLUMNS).cast("int"))
    segments = segments.withColumn("rows", F.transform(rows, lambda k: F.slice("turns", k * COLUMNS + 1, COLUMNS))).drop("turns")
    ids = lambda row: F.aggregate(row, F.lit(b""), lambda a, t: F.concat(a, t["turn_id"]))
    count = lambda row: F.aggregate(row, F.lit(0).cast("bigint"), lambda a, t: a + t["words"])
    step = lambda last, row: F.struct(
        _id(F.concat(last["chain"], ids(row))).alias("chain"), (last["before"] + count(row)).alias("before")
    )
    start = F.array(F.struct(F.lit(ROOT).alias("chain"), F.lit(0).cast("bigint").alias("before")))
    segments = segments.withColumn("chains", F.aggregate("rows", start, lambda a, r: F.concat(a, F.array(step(F.element_at(a, -1), r)))))
    segments = stored(segments, "segments")
    last = F.element_at("chains", -1)
    long = segments.filter(F.col("length") > SEGMENT).select("conv_id", "segment", last["chain"].alias("last"), last["before"].alias("words"))
    starts = (
        long.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
        .mapInArrow(_chained, "conv_id bigint, segment bigint, start binary, words_before bigint")
    )
    found = segments.join(starts, ["conv_id", "segment"], "left").select(
        "conv_id", "length", "segment", F.coalesce("start", F.lit(ROOT)).alias("start"), F.coalesce("words_before", F.lit(0)).alias("words_before"),
        "chains", F.posexplode("rows").alias("row", "turns"),
    )
    chain = lambda k: _id(F.concat("start", F.col("chains")[k]["chain"]))
    found = found.select(
        "conv_id", "length", (F.col("segment") * (SEGMENT // COLUMNS) + F.col("row")).alias("block"),
        F.when(F.col("row") == 0, F.col("start")).otherwise(chain(F.col("row"))).alias("key"), chain(F.col("row") + 1).alias("next"),
        (F.col("words_before") + F.col("chains")[F.col("row")]["before"]).alias("before"), F.col("turns.words").alias("words"),
        *(F.get("turns", F.lit(k))["turn_id"].alias(t) for k, t in enumerate(TURNS)),
    )
    empty = conversations.filter("length = 0").select(
        "conv_id", "length", F.lit(0).cast("bigint").alias("block"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("next"),
        F.lit(0).cast("bigint").alias("before"), F.array().cast("array<bigint>").alias("words"), *(F.lit(None).cast("binary").alias(t) for t in TURNS),
    )
    return stored(found.unionByName(empty), "blocks")


def _node(level: Column) -> Column:
    """The id of the node that `level` turns of a row lead to; `next` for a full row."""
    found = F.when(level == 0, F.col("key")).when(level == COLUMNS, F.col("next"))
    for k in range(1, COLUMNS):
        found = found.when(level == k, _id(F.concat("key", F.lit(b"."), *TURNS[:k])))
    return found


def _rolled(rows: DataFrame, more: str = "") -> DataFrame:
    """One row per node: `node`, `parent`, `depth`, `level`, `owner`, `n_convs`, `above` (words before its own turn), and
    the aggregates `more`."""
    level = f"({COLUMNS} - bit_count(grouping_id()))"
    above = f"before + aggregate(slice(words, 1, greatest({level} - 1, 0)), 0L, (a, w) -> a + w)"
    rolled = rows.sparkSession.sql(
        f"SELECT block, key, {', '.join(TURNS)}, {level} AS level, count(*) AS n_convs, min(conv_id) AS owner, "
        f"min(next) AS next, min({above}) AS above{more} FROM {{rows}} GROUP BY block, key, ROLLUP({', '.join(TURNS)})",
        rows=rows,
    )
    # Rows that are shorter than the level have no such prefix; the level 0 of a later row is the last of the one before.
    there = (F.col("level") == 0) & (F.col("block") == 0)
    for k, t in enumerate(TURNS, 1):
        there |= (F.col("level") == k) & F.col(t).isNotNull()
    return (
        rolled.filter(there)
        .withColumn("depth", F.col("block") * COLUMNS + F.col("level"))
        .withColumn("node", _node(F.col("level")))
        .withColumn("parent", F.when(F.col("level") > 0, _node(F.col("level") - 1)))
        .drop("block", "key", "next", *TURNS)
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(`node`, `ends_sha256`) from (`node`, ids joined by commas) in order; holds one text and one hash."""
    at, running = None, None
    names = ["node", "ends_sha256"]
    for batch in batches:
        done = []
        for node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if node != at:
                if at is not None:
                    done.append((at, running.hexdigest()))
                at, running = node, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()])], names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(`node`, `ends_sha256`): hash of the ids of the conversations that end in a node, from (`node`, `conv_id`).

    The ids of a node are ranked over all partitions and joined in chunks; the hash, which can only be taken from front to
    back, then reads one row per CHUNK ids.
    """
    rows = ranked(ends, ["node"], ["conv_id"], rank="place", size="size")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = rows.groupBy("node", F.expr(f"place div {CHUNK}").alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the conversations' prefixes, the textless root with it.

    `turns` has (`conv_id`, `length`, `place`, `turn_id`, `words`), places from 0 to `length` - 1; `conversations` one
    (`conv_id`, `length`) each, also those without turns, which are members of the root only. Result, long unless noted:
    `conv_id` (smallest member), `depth`, `parent_conv_id` (the parent's `conv_id`; null for the root), `n_convs`
    (members), `n_children`, `n_leaves` (childless nodes in the subtree, itself included), `saved_tokens` ((members - 1)
    times words of the last turn, over the subtree), `ends_sha256` (string, of the ids of members that end here). No
    conversations give no rows.
    """
    blocks = turn_blocks(turns, conversations)
    nodes = stored(_rolled(blocks), "trie-nodes")
    kids = stored(nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "trie-kids")

    # Of each conversation: the node from which on it owns, what lies above it, and whether it owns a leaf.
    owned = nodes.join(kids, "node", "left").groupBy(F.col("owner").alias("conv_id")).agg(
        F.min_by(F.struct("depth", "parent", "above"), "depth").alias("top"), F.max(F.col("n_children").isNull().cast("bigint")).alias("leaf")
    )
    level = F.greatest(F.col("length") - 1, F.lit(0)) - F.col("block") * COLUMNS + F.when(F.col("length") > 0, 1).otherwise(0)
    is_last = F.col("block") == F.expr(f"greatest(length - 1, 0) div {COLUMNS}")
    total = F.col("before") + F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + w)
    ends = stored(blocks.filter(is_last).select("conv_id", _node(level).alias("node"), total.alias("total")), "trie-ends")
    shared = ends.join(owned, "conv_id", "left").select(
        "conv_id", F.col("top.depth").alias("owns_from"), F.coalesce("top.above", "total").alias("shared"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"), F.col("top.parent").alias("node"),
    )
    above = nodes.select("node", F.col("owner").alias("parent_owner"))
    shared = stored(shared.join(above, "node", "left").drop("node"), "trie-shared")

    more = ", sum(leaf) AS n_leaves, sum(shared) AS shared, min_by(struct(shared, owns_from, parent_owner), conv_id) AS first"
    rolled = _rolled(blocks.join(shared, "conv_id"), more)
    found = rolled.join(kids, "node", "left").join(end_hashes(ends.select("node", "conv_id")), "node", "left")
    parent = F.when(F.col("depth") > F.col("first.owns_from"), F.col("owner")).otherwise(F.col("first.parent_owner"))
    return found.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("shared") - F.col("first.shared") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
