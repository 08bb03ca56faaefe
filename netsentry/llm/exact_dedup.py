"""Exact deduplication through a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. A document's digest is the SHA-256 of
that text. Each task keeps an index of the digests that are live in its rows: a new digest is inserted, a repeated one
is found through the filter, verified against the stored digest, and the entry with the smaller id is deleted and
replaced by the one with the larger. What the tasks' indexes hold at the end (a digest at most once per task, however
many copies there are) is shuffled by digest, and one more round of the same index per shard merges it. So a digest
that a third of all rows share sends one row per task through the shuffle. The number of shards follows from the number of
rows, so that a shard has about SHARD digests at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import free_name, shuffle_width, stored

SLOTS = 4  # slots of a bucket
SHARD = 200_000  # digests of a shard, about: an entry takes some 350 bytes
MAX_MOVES = 200  # evictions before the index is resized
ENTRIES = "digest binary, keep_id bigint, keep_row bigint, n bigint"


class CuckooIndex:
    """Live keys with a value each, behind a cuckoo filter.

    A key has a 16-bit tag and two buckets, the second found from the first and the tag alone. A slot holds the tag (the
    filter) and, at the same place of a parallel bucket, the whole key and its value, against which a tag hit is
    verified. When an insertion still finds no slot after `MAX_MOVES` evictions, the table is doubled and filled again
    from the stored keys. Keys are digests, so their bytes serve as hash values.
    """

    def __init__(self, buckets: int = 64):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple]] = [[] for _ in range(buckets)]
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def _places(self, key: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(key[:2], "little") | 1 << 16
        first = int.from_bytes(key[2:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ (tag * 0x5BD1E995 >> 7 & self.mask)

    def _find(self, key: bytes) -> tuple[int, int] | None:
        tag, first, second = self._places(key)
        for bucket in (first, second):
            tags = self.tags[bucket]
            if tag in tags:
                content = self.content[bucket]
                for slot, held in enumerate(tags):
                    if held == tag and content[slot][0] == key:
                        return bucket, slot
        return None

    def get(self, key: bytes):
        """The key's value, or None if it is not live."""
        place = self._find(key)
        return place and self.content[place[0]][place[1]][1]

    def delete(self, key: bytes) -> bool:
        """Takes the key out; False if it was not live."""
        place = self._find(key)
        if place is None:
            return False
        bucket, slot = place
        del self.tags[bucket][slot], self.content[bucket][slot]
        self.size -= 1
        return True

    def insert(self, key: bytes, value) -> None:
        """Adds a key that is not live."""
        tag, first, second = self._places(key)
        entry = (key, value)
        bucket = first if len(self.tags[first]) <= len(self.tags[second]) else second
        for move in range(MAX_MOVES):
            if len(self.tags[bucket]) < SLOTS:
                self.tags[bucket].append(tag)
                self.content[bucket].append(entry)
                self.size += 1
                return
            slot = move % SLOTS
            self.tags[bucket][slot], tag = tag, self.tags[bucket][slot]
            self.content[bucket][slot], entry = entry, self.content[bucket][slot]
            bucket = self._other(bucket, tag)
        live = [*self.items(), entry]
        self._clear(2 * (self.mask + 1))
        for held in live:
            self.insert(*held)

    def items(self) -> Iterator[tuple]:
        for bucket in self.content:
            yield from bucket


def _add(index: CuckooIndex, key: bytes, keep_id, keep_row: int, n: int) -> None:
    held = index.get(key)
    if held is None:
        index.insert(key, (keep_id, keep_row, n))
        return
    mine, theirs = (keep_id is not None, keep_id or 0, keep_row), (held[0] is not None, held[0] or 0, held[1])
    index.delete(key)
    index.insert(key, ((keep_id, keep_row) if mine > theirs else held[:2]) + (held[2] + n,))


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for entry in zip(*(column.to_pylist() for column in batch.columns)):
            _add(index, *entry)
    found = list(index.items())
    for at in range(0, len(found), 10_000):
        part = found[at : at + 10_000]
        columns = [[key for key, _ in part], *([value[k] for _, value in part] for k in range(3))]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, ["digest", "keep_id", "keep_row", "n"])


def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z in lower case, as UTF-8; null as empty."""
    found = []
    for at in range(0, len(text), 500):  # so that few texts are held twice
        lowered = pc.ascii_lower(text.slice(at, 500).fill_null("")).cast(pa.binary())
        found += [hashlib.sha256(t.as_buffer()).digest() for t in lowered]
    return pa.array(found, pa.binary())


def live_digests(digests: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per digest (`digest`, `keep_id`, `keep_row`, `n`) from stored rows (`digest`, id, row), read twice."""
    shards = max(shuffle_width(digests.sparkSession), -(-digests.count() // shard))
    rows = digests.select("digest", *digests.columns[1:3], F.lit(1).cast("bigint"))
    local = rows.mapInArrow(_live, ENTRIES)
    return local.repartition(shards, "digest").mapInArrow(_live, ENTRIES)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of `docs` with its class of equal texts.

    Adds `digest` (binary), `keep_id` (largest id of the class), `group_size` (rows of the class) and `kept` (true for
    one row of each class). Column names that are taken get underscores before them. Null text equals empty text. Null
    ids come after all others: such a row stays only where its class has no other, and `keep_id` is then null. Of rows
    that share text and id, exactly one is kept. Empty tables give no rows. `keep_text=False` leaves the text out of the
    result and of what is stored.
    """
    names = {n: free_name(docs, n) for n in ("digest", "keep_id", "group_size", "kept")}
    row, keep = free_name(docs, "row_key"), free_name(docs, "keep_row")
    rows = docs.withColumn(names["digest"], F.arrow_udf(text_digest, "binary")(F.col(text_column).cast("string"))).withColumn(row, F.monotonically_increasing_id())
    rows = stored(rows if keep_text else rows.drop(text_column), "digests")
    live = live_digests(
        rows.select(
            F.col(names["digest"]).alias("digest"), F.col(id_column).cast("bigint").alias("id"), F.col(row).alias("row")
        )
    )
    live = stored(live, "live-digests").select(
        F.col("digest").alias(names["digest"]),
        F.col("keep_id").alias(names["keep_id"]),
        F.col("n").alias(names["group_size"]),
        F.col("keep_row").alias(keep),
    )
    # A hot digest is one row on the right; the many rows on the left are split by adaptive execution.
    return (
        rows.join(live, names["digest"])
        .withColumn(names["kept"], F.col(row) == F.col(keep))
        .drop(row, keep)
    )
