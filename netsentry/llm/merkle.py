"""A Merkle manifest: digests of rows, a tree of digests per group, one root, and a proof for every row.

A leaf's place in its group, written in base `arity`, is a row of digit columns. Within a block of arity ** `digits`
consecutive leaves these columns are grouped away one after the other, the lowest first: nodes that agree in the digits
left become the children, as nested structs in an array, of one node. A block is so one row with its whole subtree, and
never larger than the block; grouping needs one shuffle per block size, since all its steps keep the block's key. The
digests of the blocks' tops are the leaves of the next tier, up to one node per group; the groups' tops, in order, are
the leaves of the last tree.

Proofs come down the same way. The row of a block and the row with the path of its top meet in a group of two rows, not
in a join; nested transforms hand each child its parent's path with the step of its own run before it, and one explode
gives the rows of the leaves. A step of a proof has the digests of the run's other nodes, before and after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import stored
from netsentry.llm.ranks import ranked

DIGITS = 10  # of a block: 1,024 leaves of a binary tree
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as `-` if null, else the UTF-8 bytes of its text, a colon, and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings(path: Column) -> Column:
    """The digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def _nodes(size: Column, arity: int, level: int) -> Column:
    """How many nodes a tree of `size` leaves has at a level."""
    return F.ceil(size / F.lit(arity**level))


def _joined(kids: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.transform(F.slice(kids, start, length), lambda kid: kid["node"]["digest"]), "")


def _blocks(nodes: DataFrame, arity: int, digits: int) -> DataFrame:
    """(`grp`, `size`, `block`, `node`) with the nested subtree of each block, from (`grp`, `size`, `rank`, `digest`,
    `item`)."""
    key = [F.col("grp"), F.col("size"), F.expr(f"rank div {arity**digits}").alias("block")]
    columns = [F.expr(f"rank div {arity**k} % {arity}").alias(f"digit_{k}") for k in range(digits)]
    level = nodes.select(*key, *columns, F.struct("digest", "item").alias("node")).repartition("grp", "size", "block")
    for k in range(digits):
        left = ["grp", "size", "block", *(f"digit_{j}" for j in range(k + 1, digits))]
        level = level.groupBy(*left).agg(F.array_sort(F.collect_list(F.struct(f"digit_{k}", "node"))).alias("kids"))
        # A tree that has one node left stays as it is.
        whole = F.when(_nodes(F.col("size"), arity, k) > 1, F.sha2(_joined(F.col("kids"), 1, arity), 256))
        top = F.coalesce(whole, F.col("kids")[0]["node"]["digest"])
        level = level.select(*left, F.struct(top.alias("digest"), "kids").alias("node"))
    return level


def _leaves(tier: DataFrame, arity: int, digits: int) -> DataFrame:
    """(`item`, `digest`, `path`, `tops`) of each leaf, from blocks with the path of their tops."""
    size = F.col("size")

    def kids_of(level: int) -> Callable[[Column], Column]:
        def step(kids: Column, place: Column) -> Column:
            own = F.struct(
                _joined(kids, 1, place).alias("before"), _joined(kids, place + 2, arity).alias("after")
            )
            return F.when(_nodes(size, arity, level) > 1, F.array(own)).otherwise(F.array().cast(PATH))

        return lambda parent: F.transform(
            parent["node"]["kids"],
            lambda kid, place: F.struct(
                kid["node"].alias("node"),
                F.concat(step(parent["node"]["kids"], place), parent["path"]).alias("path"),
            ),
        )

    found = F.array(F.struct("node", "path"))
    for level in reversed(range(digits)):
        found = F.flatten(F.transform(found, kids_of(level)))
    leaf = tier.select("tops", F.explode(found).alias("leaf"))
    return leaf.select("leaf.node.item", "leaf.node.digest", "leaf.path", "tops")


def _paths(nodes: DataFrame, arity: int, digits: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(`item`, `digest`, `path`, `tops`) of each node: its proof up to the last root, and the roots on the way.

    `above` gives (`grp`, `block`, `path`, `tops`) for the tops (`grp`, `block`, `digest`) of the groups' trees; without
    it a group's tree is the last one.
    """
    span = arity**digits
    tier = stored(_blocks(nodes, arity, digits), "merkle-blocks")
    most = tier.agg(F.max("size")).first()[0] or 0
    if most > span:
        upper = tier.select(
            "grp", _nodes(F.col("size"), arity, digits).alias("size"), F.col("block").alias("rank"), "node.digest",
            F.struct("grp", "block").alias("item"),
        )
        up = _paths(upper, arity, digits, above).select("item.grp", "item.block", "path", "tops")
    elif above:
        up = above(tier.select("grp", "block", "node.digest"))
    else:
        up = tier.select("grp", "block", F.array().cast(PATH).alias("path"), F.array("node.digest").alias("tops"))
    met = tier.unionByName(up, allowMissingColumns=True).groupBy("grp", "block")
    met = met.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("size", "node", "path", "tops")))
    return _leaves(met, arity, digits)


def manifest(
    leaves: DataFrame, key: str, group: str, leaf: str, carried: tuple[str, ...] = (), arity: int = 2, digits: int = DIGITS
) -> DataFrame:
    """One row per row of `leaves`: `key`, `group`, `leaf` and the columns `carried`, with `proof`, `subroot`, `root`.

    Leaves of a group ascend by `key` (null first, ties by `leaf`, equal rows in any order). As long as a level has
    several nodes, every `arity` consecutive ones become the SHA-256 of their digests as text; the last run may be
    shorter. The groups' tops, by group (null first, strings by their bytes), are joined to one root in the same way.
    `proof` has, from the leaf up, the digests `before` and `after` the node in its run; empty for the only leaf of all.
    No column of `leaves` may be called like the three that are added. An empty table gives no rows.
    """
    if arity < 2 or digits < 1:
        raise ValueError("arity must be 2 or more and a block have a digit at least")
    items = leaves.select(F.col(group).alias("grp"), F.struct(key, leaf, *carried).alias("item"))
    items = items.withColumn("by", F.col("item")[key]).withColumn("digest", F.col("item")[leaf])
    placed = ranked(items, ["grp"], ["by", "digest"])

    def over_groups(tops: DataFrame) -> DataFrame:
        rows = ranked(tops.select(F.lit(0).alias("one"), "grp", "digest"), ["one"], ["grp"])
        rows = rows.select(F.col("one").alias("grp"), "size", "rank", "digest", F.struct("grp").alias("item"))
        found = _paths(rows, arity, digits)
        return found.select("item.grp", F.lit(0).cast("bigint").alias("block"), "path", F.concat(F.array("digest"), "tops").alias("tops"))

    named = placed.select("grp", "size", "rank", "digest", F.struct("grp", "item").alias("item"))
    found = _paths(named, arity, digits, over_groups)
    return found.select(
        f"item.item.{key}", F.col("item.grp").alias(group), f"item.item.{leaf}", *(f"item.item.{c}" for c in carried),
        F.col("path").alias("proof"), F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"),
    )


def document_leaf(docs: DataFrame, n_chars: Column | None = None) -> Column:
    """The digest of a row of documents; `n_chars` in the place of its own."""
    size = docs["n_chars"] if n_chars is None else n_chars
    return digest(*(field(c) for c in (docs["doc_id"], docs["source"], docs["lang"], size, docs["text"])))


def audited(docs: DataFrame, tampered: Column, arity: int = 2, digits: int = DIGITS) -> DataFrame:
    """The manifest of `docs`, held against rows of which those that are `tampered` have one more in `n_chars`.

    `doc_id`, `leaf`, `subroot`, `root`, `proof_sha256` of the rows as they are; `folded_root` from the tampered row and
    the proof; `verified` if it is the root. Null `n_chars` stay null, a null `tampered` is false. Nulls in any column
    are part of the leaf; rows with the same `doc_id` are leaves of their own; other columns are not read.
    """
    more = docs["n_chars"].cast("decimal(20,0)") + 1  # the largest bigint has a successor here
    rows = docs.select(
        "doc_id", "lang", document_leaf(docs).alias("leaf"), F.when(tampered, document_leaf(docs, more)).alias("claim")
    )
    found = manifest(rows, "doc_id", "lang", "leaf", ("claim",), arity, digits)
    found = found.withColumn("folded_root", fold(F.coalesce("claim", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
