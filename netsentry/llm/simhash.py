"""Near-duplicates by SimHash fingerprints, linked through vantage-point trees.

Fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit in one of their halves. So each half has a
vantage-point tree of its own, in which pairs within distance 1 are sought: a node compares points with a vantage point
and splits them at the median distance m. By the triangle inequality two points within r of each other either both lie
within m + r or both lie beyond m; points with m < distance <= m + r lie on the boundary and go to both sides. With
r = 1 those are some 13 % of the points at each split, with r = 3 on all 64 bits they would be half.

The upper levels of a tree are the same for all tasks (vantage points and medians of a bounded sample of fingerprints)
and name the shard; a fingerprint goes to its own shard and to those whose boundary it is in. The lower levels are built
in the shard's task. Leaves compare all 64 bits. Shards give links of each class to its first member, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netsentry.llm.common import free_name, stored
from netsentry.llm.components import connected_components

MAX_BITS = 3  # differing bits of linked fingerprints
RADIUS = 1  # differing bits in one half
SEED = 42  # of XXH64
SHARD = 20_000  # fingerprints of a shard, about
SAMPLE = 4_096  # fingerprints from which vantage points and medians come
LEAF = 64  # points of a leaf
PAIRS = 1 << 20  # comparisons at a time


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included; 0 without words. A-Z are lower-cased first."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(line, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])
    set_bits = np.zeros(64, np.int64)
    shingles = len(starts)
    for at in range(0, shingles, 8192):
        part = np.frombuffer(raw[8 * at : 8 * (at + 8192)], np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > shingles).tobytes(), "big")


def fingerprints(text: pa.Array) -> pa.Array:
    """As signed 64-bit numbers."""
    found = np.fromiter((fingerprint(t.as_py()) for t in text), np.uint64, len(text))
    return pa.array(found.view(np.int64))


def halves(points: np.ndarray, half: int) -> np.ndarray:
    return (points >> np.uint64(32 * (1 - half))).astype(np.uint32)


class Levels:
    """The upper levels of one half's tree: vantage points and the distances at which they split."""

    def __init__(self, sample: np.ndarray, half: int, depth: int):
        keys = halves(sample, half)
        self.half = half
        self.vantages = keys[:depth]
        self.medians = [int(np.median(np.bitwise_count(keys ^ v))) for v in self.vantages]

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, shard): every side of every split the point belongs to."""
        at, shard, keys = np.arange(len(points)), np.zeros(len(points), np.int64), halves(points, self.half)
        for vantage, median in zip(self.vantages, self.medians):
            distance = np.bitwise_count(keys[at] ^ vantage)
            inner, outer = distance <= median + RADIUS, distance > median
            at, shard = np.concatenate((at[inner], at[outer])), np.concatenate((2 * shard[inner], 2 * shard[outer] + 1))
        return at, shard


def _merge(roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Classes (each point names a smaller one of its class) after the pairs are joined."""
    while len(left):
        a, b = roots[left], roots[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(roots, a, least)
        np.minimum.at(roots, b, least)
        while True:
            shorter = roots[roots]
            if (shorter == roots).all():
                break
            roots = shorter
    return roots


def link_classes(points: np.ndarray, half: int) -> np.ndarray:
    """For each point the first one (by position) that it is linked with, directly or not, among pairs whose half is
    within RADIUS. Points are different fingerprints (uint64)."""
    roots = np.arange(len(points))
    keys = halves(points, half)
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []

    def compare(own: np.ndarray) -> None:
        nonlocal roots
        step = max(1, PAIRS // len(own))
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            near = np.bitwise_count(points[rows][:, None] ^ points[own][None, :]) <= MAX_BITS
            i, j = np.nonzero(near)
            apart = rows[i] < own[j]
            if apart.any():
                lefts.append(rows[i[apart]])
                rights.append(own[j[apart]])
                if sum(map(len, lefts)) > PAIRS:
                    roots = _merge(roots, np.concatenate(lefts), np.concatenate(rights))
                    lefts.clear()
                    rights.clear()

    # Points, the metric to split by, and how many vantage points in a row have not split them.
    todo = [(roots.copy(), keys, RADIUS, 0)] if len(points) else []
    while todo:
        own, metric, radius, failed = todo.pop()
        if len(own) <= LEAF:
            compare(own)
            continue
        vantage = own[(len(own) // 2 + 7 * failed) % len(own)]
        distance = np.bitwise_count(metric[own] ^ metric[vantage])
        median = int(np.median(distance))
        inner, outer = own[distance <= median + radius], own[distance > median]
        if max(len(inner), len(outer)) <= 0.9 * len(own):
            todo += [(inner, metric, radius, 0), (outer, metric, radius, 0)]
        elif failed < 3:
            todo.append((own, metric, radius, failed + 1))
        elif metric is keys:
            todo.append((own, points, MAX_BITS, 0))  # the half does not tell them apart: split by all bits
        else:
            compare(own)
    return _merge(roots, np.concatenate(lefts), np.concatenate(rights)) if lefts else roots


def near_links(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (`a`, `b`) between nodes whose fingerprints are within MAX_BITS, enough of them to connect what is linked.

    `nodes` has different fingerprints: `fingerprint`, `node` (bigint). It must be stored: it is read three times.
    """
    count = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / shard)))
    sample = nodes.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect()
    sample = np.array([row[0] for row in sample], np.int64).view(np.uint64)
    trees = [Levels(sample, half, min(depth, len(sample))) for half in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in trees:
                at, shards = tree.shards(points)
                key = pa.array(2 * shards + tree.half)
                yield pa.RecordBatch.from_arrays(
                    [key, batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["shard", "fingerprint", "node"]
                )

    def link(key: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        points = shard.column("fingerprint").to_numpy().view(np.uint64)
        node = shard.column("node").to_numpy()
        order = np.argsort(node)
        roots = link_classes(points[order], int(key[0].as_py()) % 2)
        linked = np.nonzero(roots != np.arange(len(roots)))[0]
        return pa.table({"a": node[order][linked], "b": node[order][roots[linked]]})

    dealt = nodes.select("fingerprint", "node").mapInArrow(deal, "shard bigint, fingerprint bigint, node bigint")
    return dealt.groupBy("shard").applyInArrow(link, "a bigint, b bigint")


def simhash_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of `docs` without its text, with `fingerprint` (bigint) and `component_id`.

    `component_id` is the smallest id that the row reaches over links between fingerprints, its own included. Null and
    empty texts, and texts of separators only, have fingerprint 0 and are linked like any other; shorter texts than a
    shingle are one shingle. Rows with equal texts or ids are members like any other. Rows with a null id are linked
    among each other and to others only through equal fingerprints: they have the class of their fingerprint, and a null
    `component_id` if nobody in it has an id. Taken column names get underscores. Empty tables give no rows.
    """
    mark, component, found = (free_name(docs, n) for n in ("fingerprint", "component_id", "found_fingerprint"))
    rows = docs.withColumn(mark, F.arrow_udf(fingerprints, "bigint")(F.col(text_column).cast("string"))).drop(text_column)
    rows = stored(rows, "fingerprints")
    # One node per fingerprint, however many documents share it.
    nodes = rows.groupBy(F.col(mark).alias("fingerprint")).agg(F.min(F.col(id_column).cast("bigint")).alias("node"))
    nodes = stored(nodes, "fingerprint-nodes")
    classes = connected_components(near_links(nodes.filter("node is not null")))
    named = nodes.join(classes, "node", "left").select(
        F.col("fingerprint").alias(found), F.coalesce("component", "node").alias(component)
    )
    return rows.join(named, F.col(mark) == F.col(found)).drop(found)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`docs` with the row of the smallest id of each class only, columns unchanged; rows with a null id are one by one
    as they came. Of rows that share id and class one stays."""
    row = free_name(docs, "row_key")
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-input")
    classes = simhash_classes(keyed.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(row).alias("row")), "id")
    first = classes.filter("id is null or id = component_id")
    number = F.row_number().over(W.partitionBy("component_id", "id", F.when(F.col("id").isNull(), F.col("row"))).orderBy("row"))
    first = first.withColumn("nth", F.when(F.col("id").isNull(), 1).otherwise(number)).filter("nth = 1")
    return keyed.join(first.select(F.col("row").alias(row)), row, "left_semi").drop(row)
