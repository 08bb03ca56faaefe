"""Removal of repeated passages with a sparse, range-partitioned suffix array over UTF-8 bytes.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id. Sorting a suffix for
every byte would multiply the input, so only suffixes at anchors are sorted. A window of LENGTH bytes has the anchor where
its GRAM-byte string with the smallest hash starts (the leftmost of equal ones); equal windows have their anchors at the
same offset, so two equal windows always meet at their anchors. About one byte in 13 is an anchor.

1. Documents are packed (about PACK bytes each, compressed) and stored.
2. Each pack sends its anchors' gram hashes to buckets; a bucket finds those of more than one document and answers each
   pack with one bit per hash. The hash only filters; a collision costs work, not correctness.
3. Each pack sends the suffixes of shared anchors, with the bytes before them, to the bucket of their gram. Splitters are
   whole grams at even ranks of a sample of what will be sent, so suffixes that begin alike are cut as well; only those of
   one gram stay together. Splitters are MAX_RANGES at most, as every task has them; where more buckets are needed, a hash
   of the gram deals each range to several. A bucket sorts its suffixes by multikey quicksort, compares neighbours,
   and classes of equal prefixes and equal bytes before the anchor tell for every window the smallest document it occurs
   in. A gram in very many packs could fill a bucket with different suffixes and would be cut by no splitter; its windows
   are sent one by one instead, by their own hash, so that no class of windows lies across a boundary.
4. Each pack gets the windows to remove back and gives its documents' results.

A document is in one pack whatever its size; its bytes are hashed in overlapping pieces of PIECE bytes.

A pack sends each gram, suffix or window once, however many of its documents have it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import shuffle_width, stored
from netsentry.llm.ranks import ranked

LENGTH, GRAM = 50, 26
BEFORE = LENGTH - GRAM  # bytes before an anchor that a window can reach
OFFSETS = BEFORE + 1  # places of the anchor in a window
RECORD = LENGTH + BEFORE + 2  # suffix, bytes before it backwards, how many there are of each
PACK = 1 << 21
PIECE = 1 << 20  # bytes that are hashed at once
GRAM_BUCKET = 4_000_000  # gram hashes that a bucket of step 2 compares, about
BUCKET = 500_000  # suffixes or windows that a bucket of step 3 compares, about
MAX_RANGES = 16_384  # ranges between splitters
SAMPLED = 128  # one gram in so many that a pack sends is in the sample
HOT = 512  # packs with a gram from which on its windows are sent one by one
LEVEL = 5  # of the packs' compression: they are stored once and shuffled twice
NO_ID = np.iinfo(np.int64).max  # documents without id come after all others


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_STEPS = [np.uint64(k) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    one = _BYTES[raw]
    two = one[:-1] * _STEPS[0] + one[1:]
    four = two[:-2] * _STEPS[1] + two[2:]
    eight = four[:-4] * _STEPS[2] + four[4:]
    sixteen = eight[:-8] * _STEPS[3] + eight[8:]
    size = len(raw) - GRAM + 1
    return _mix((sixteen[:size] * _STEPS[4] + eight[16 : 16 + size]) * _STEPS[2] + two[24 : 24 + size])


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of the window from each place on: smallest upper half of the hash, leftmost of equal ones."""
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        key = np.minimum(key[:-step], key[step:])
    key = np.minimum(key[: len(hashes) - OFFSETS + 1], key[OFFSETS - 16 :][: len(hashes) - OFFSETS + 1])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Pack:
    """Documents in a row, their anchors, and which windows each anchor has."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.raw = np.frombuffer(zstandard.decompress(row["blob"]) if self.sizes.sum() else b"", np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        empty = np.zeros(0, np.int64)
        self.anchors = self.first = self.last = self.owner = empty
        self.keys = empty.astype(np.uint64)
        if len(self.raw) < LENGTH:
            return
        parts = [self._piece(start) for start in range(0, len(self.raw) - LENGTH + 1, PIECE)]
        anchors, owner, first, last, keys = (np.concatenate(c) for c in zip(*parts))
        # An anchor whose windows start in two pieces is one anchor.
        new = np.ones(len(anchors), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        at = np.nonzero(new)[0]
        self.anchors, self.owner, self.first, self.keys = anchors[at], owner[at], first[at], keys[at]
        self.last = last[np.append(at[1:], len(anchors)) - 1] if len(at) else empty

    def _piece(self, start: int) -> tuple[np.ndarray, ...]:
        """(anchor, document, first window, last window, gram hash) of the windows that start in PIECE bytes from here on."""
        hashes = gram_hashes(self.raw[start : start + PIECE + LENGTH - 1])
        anchors = window_anchors(hashes) + start
        place = np.arange(start, start + len(anchors))
        owner = np.searchsorted(self.ends, place, "right")
        inside = place + LENGTH <= self.ends[owner]
        place, anchors, owner = place[inside], anchors[inside], owner[inside]
        new = np.ones(len(place), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        at = np.nonzero(new)[0]
        last = place[np.append(at[1:], len(place)) - 1] if len(at) else place
        return anchors[at], owner[at], place[at], last, _mix(hashes[anchors[at] - start] * np.uint64(0xD6E8FEB86659FD93))

    def routed(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, hash within it, whether several documents here have it, an anchor that has it) of each different gram
        in order, and for each anchor the place of its gram there."""
        bucket = (self.keys >> np.uint64(40)) % np.uint64(buckets)
        whole = (bucket << np.uint64(32)) | (self.keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(whole, kind="stable")
        ordered = whole[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        at = np.nonzero(new)[0]
        last = np.append(at[1:], len(order)) - 1
        several = self.owner[order[at]] != self.owner[order[last]] if len(at) else np.zeros(0, bool)
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        grams = (ordered[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return (ordered[at] >> np.uint64(32)).astype(np.int64), grams, several, order[at], where

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, id) of the chosen anchors. A record has the LENGTH bytes from the anchor on, the BEFORE bytes before
        it backwards, both filled with zeros at the document's ends, and how many of each there are."""
        at, owner = self.anchors[chosen], self.owner[chosen]
        padded = np.concatenate((np.zeros(BEFORE, np.uint8), self.raw, np.zeros(LENGTH, np.uint8)))
        records = np.empty((len(at), RECORD), np.uint8)
        after = np.minimum(LENGTH, self.ends[owner] - at)
        before = np.minimum(BEFORE, at - self.starts[owner])
        for k in range(LENGTH):
            records[:, k] = padded[at + BEFORE + k] * (k < after)
        for k in range(BEFORE):
            records[:, LENGTH + k] = padded[at + BEFORE - 1 - k] * (k < before)
        records[:, -2], records[:, -1] = before, after
        return records, self.ids[owner]

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        """The windows of the chosen anchors."""
        first, last = self.first[chosen], self.last[chosen]
        counts = last - first + 1
        if not len(counts):
            return np.zeros(0, np.int64)
        return np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())

    def window_records(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        records = self.raw[windows[:, None] + np.arange(LENGTH)] if len(windows) else np.zeros((0, LENGTH), np.uint8)
        owner = np.searchsorted(self.starts, windows, "right") - 1
        return records, self.ids[owner]


def multikey_order(records: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
    """The order of the records by their bytes: sorted by the first token of eight bytes, then each run of equal ones by
    the next token, and so on. `above` comes before the bytes."""
    count, width = records.shape
    order = np.argsort(above, kind="stable") if above is not None else np.arange(count)
    run = np.zeros(count, np.int64)
    if above is not None and count:
        run[1:] = np.cumsum(above[order][1:] != above[order][:-1])
    for level in range(0, width, 8):
        sizes = np.bincount(run, minlength=1)
        open_ = np.nonzero(sizes[run] > 1)[0]
        if not len(open_):
            break
        token = np.zeros((len(open_), 8), np.uint8)
        token[:, : width - level] = records[order[open_], level : level + 8]
        token = token.view(">u8").ravel().astype(np.uint64)
        within = np.lexsort((token, run[open_]))
        order[open_] = order[open_][within]
        token, old = token[within], run[open_]
        cut = np.zeros(count, np.int64)
        cut[open_[1:]] = (token[1:] != token[:-1]) & (old[1:] == old[:-1])
        first = np.ones(count, bool)
        first[1:] = run[1:] != run[:-1]
        run = np.cumsum(first | (cut > 0)) - 1
    return order


def common_prefix(ordered: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each record and the one before it; 0 for the first."""
    out = np.zeros(len(ordered), np.int64)
    for start in range(1, len(ordered), 1 << 16):
        stop = min(start + (1 << 16), len(ordered))
        differs = ordered[start:stop] != ordered[start - 1 : stop - 1]
        out[start:stop] = np.where(differs.any(axis=1), differs.argmax(axis=1), ordered.shape[1])
    return out


def _least(key: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The smallest value among those with the same key, for each."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    at = np.nonzero(new)[0]
    out = np.empty_like(values)
    out[order] = np.repeat(np.minimum.reduceat(values[order], at), np.diff(np.append(at, len(order))))
    return out


def repeated_windows(records: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix record the windows (bit x: the window that starts x bytes before the anchor) that also start in a
    document with a smaller id, among these records."""
    count = len(records)
    masks = np.zeros(count, np.int32)
    if count < 2:
        return masks
    order = multikey_order(records[:, :LENGTH])
    forward = common_prefix(records[order, :LENGTH])
    gram = np.cumsum(forward < GRAM)  # suffixes with the same gram are neighbours
    backward = multikey_order(records[order, LENGTH : LENGTH + BEFORE], gram)
    before = common_prefix(records[order][backward, LENGTH : LENGTH + BEFORE])
    before[1:][gram[backward][1:] != gram[backward][:-1]] = -1
    own, smaller = ids[order], np.zeros(count, np.int32)
    has_before, has_after = records[order, -2].astype(int), records[order, -1].astype(int)
    for x in range(OFFSETS):
        valid = np.nonzero((has_before >= x) & (has_after >= LENGTH - x))[0]
        if len(valid) < 2:
            continue
        right = np.cumsum(forward < LENGTH - x)
        left = np.empty(count, np.int64)
        left[backward] = np.cumsum(before < x)
        key = (left[valid] << 32) | right[valid]
        smaller[valid] |= (_least(key, own[valid]) < own[valid]).astype(np.int32) << x
    masks[order] = smaller
    return masks


def _rows(columns: dict[str, pa.DataType]):
    """A function that makes a table of (name: list) columns of these types."""
    return lambda lists: pa.table({n: pa.array(lists[k], t) for k, (n, t) in enumerate(columns.items())})


def pack_documents(docs: DataFrame, pack_bytes: int = PACK) -> DataFrame:
    """(`pack`, `bytes`, `ids`, `sizes`, `blob`) from (id bigint, text string)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            blob = zstandard.compress(b"".join(texts), LEVEL)
            row = [base + number], [held], [np.array(ids, np.int64).tobytes()], [sizes.tobytes()], [blob]
            ids.clear()
            texts.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["pack", "bytes", "ids", "sizes", "blob"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                raw = text.as_py() or b""
                if texts and held + len(raw) > pack_bytes:
                    yield flush()
                ids.append(NO_ID if key is None else key)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield flush()

    return docs.mapInArrow(packed, "pack bigint, bytes bigint, ids binary, sizes binary, blob binary")


def _found(pack: pa.Table) -> Pack | None:
    return Pack(pack.slice(0, 1).to_pylist()[0]) if pack.num_rows else None


def gram_rows(packs: DataFrame, buckets: int) -> DataFrame:
    """Step 2, out: (`bucket`, `pack`, `grams`, `several`, `picks`, `leads`). Picks are the places of the grams in the
    sample, drawn anew in each pack so that a gram of many packs is in it in proportion; leads their bytes."""
    kinds = {"bucket": pa.int64(), "pack": pa.int64()} | dict.fromkeys(("grams", "several", "picks", "leads"), pa.binary())
    table = _rows(kinds)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Pack(row)
                bucket, gram, several, one, _ = pack.routed(buckets)
                draw = _mix(pack.keys[one] ^ _mix(np.array([row["pack"] + 1], np.uint64) * _STEPS[0])) >> np.uint64(8)
                picked = draw % np.uint64(SAMPLED) == 0
                cuts = np.nonzero(np.diff(bucket, prepend=-1))[0]
                rows = []
                for a, b in zip(cuts, np.append(cuts[1:], len(bucket))):
                    picks = np.nonzero(picked[a:b])[0].astype(np.uint32)
                    leads = pack.raw[pack.anchors[one[a + picks]][:, None] + np.arange(GRAM)]
                    blobs = gram[a:b], np.packbits(several[a:b]), picks, leads
                    rows.append((int(bucket[a]), row["pack"], *(x.tobytes() for x in blobs)))
                yield from table(list(zip(*rows)) if rows else [[]] * 6).to_batches()

    return packs.mapInArrow(sent, "bucket bigint, pack bigint, grams binary, several binary, picks binary, leads binary")


def shared_grams(grams: DataFrame, hot_packs: int = HOT) -> DataFrame:
    """Step 2, back: (`pack`, `bucket`, `shared`, `hot`), a bit for each gram that the pack sent; `n_shared` and `n_hot`,
    how many are shared and not hot, and shared and hot; `leads`, the sampled ones of the former."""
    table = _rows({"pack": pa.int64(), "bucket": pa.int64(), "shared": pa.binary(), "hot": pa.binary(), "n_shared": pa.int64(), "n_hot": pa.int64(), "leads": pa.binary()})

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        grams_ = [np.frombuffer(g, np.uint32) for g in rows.column("grams").to_pylist()]
        several = [np.unpackbits(np.frombuffer(s, np.uint8))[: len(g)] for s, g in zip(rows.column("several").to_pylist(), grams_)]
        whole = np.concatenate(grams_)
        _, where, counts = np.unique(whole, return_inverse=True, return_counts=True)
        shared = np.bincount(where, np.concatenate(several)) + (counts > 1)
        shared, hot = shared[where] > 0, counts[where] >= hot_packs
        samples = zip(rows.column("picks").to_pylist(), rows.column("leads").to_pylist())
        out, at = [], 0
        for pack, gram, (picks, leads) in zip(rows.column("pack").to_pylist(), grams_, samples):
            own, often = shared[at : at + len(gram)], hot[at : at + len(gram)]
            at += len(gram)
            if own.any():
                plain = own & ~often
                leads = np.frombuffer(leads, np.uint8).reshape(-1, GRAM)[plain[np.frombuffer(picks, np.uint32)]]
                bits = np.packbits(own).tobytes(), np.packbits(often).tobytes()
                out.append((pack, key[0].as_py(), *bits, int(plain.sum()), int((own & often).sum()), leads.tobytes()))
        return table(list(zip(*out)) if out else [[]] * 7)

    schema = "pack bigint, bucket bigint, shared binary, hot binary, n_shared bigint, n_hot bigint, leads binary"
    return grams.groupBy("bucket").applyInArrow(compare, schema)


def splitters(sample: DataFrame, ranges: int) -> list[bytes]:
    """At most `ranges` - 1 different grams at even ranks of the sample (binary, grams in a row). Ranks are exact: the
    sample is sorted by range, and only the splitters come to the driver."""
    if ranges < 2:
        return []

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leads in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([leads[k : k + GRAM] for k in range(0, len(leads), GRAM)], pa.binary())], ["lead"])

    rows = ranked(sample.mapInArrow(single, "lead binary"), [], ["lead"])
    share = lambda rank: F.floor(rank * F.lit(ranges) / F.col("size"))
    cuts = rows.filter((F.col("rank") > 0) & (share(F.col("rank")) > share(F.col("rank") - 1))).select("lead").distinct()
    return sorted(bytes(r.lead) for r in cuts.collect())


@dataclass(frozen=True)
class Route:
    """Where grams, suffixes and windows go."""

    grams: int  # buckets of step 2
    cuts: tuple[bytes, ...]  # splitters
    parts: int  # buckets of each range
    windows: int  # buckets of windows

    def suffix_bucket(self, records: np.ndarray) -> np.ndarray:
        """The bucket of each suffix record: by its whole gram, so that suffixes of one gram are together."""
        if not len(records):
            return np.zeros(0, np.int64)
        leads = np.ascontiguousarray(records[:, :GRAM])
        place = np.searchsorted(np.array(self.cuts, f"S{GRAM}"), leads.view(f"S{GRAM}").ravel(), "right").astype(np.int64)
        if self.parts == 1:
            return place
        return place * self.parts + (_mix(gram_hashes(leads.ravel())[::GRAM]) % np.uint64(self.parts)).astype(np.int64)

    def window_bucket(self, records: np.ndarray) -> np.ndarray:
        if not len(records):
            return np.zeros(0, np.int64)
        heads = gram_hashes(records.ravel())[::LENGTH]
        tails = gram_hashes(records[:, LENGTH - GRAM :].copy().ravel())[::GRAM]
        return (_mix(heads * _STEPS[0] + tails) % np.uint64(self.windows)).astype(np.int64)


class Sent:
    """What a pack sends in step 3: different suffix records and windows by bucket, in an order that step 4 finds again."""

    def __init__(self, pack: Pack, flags: list[dict], route: Route):
        bucket, _, _, _, where = pack.routed(route.grams)
        shared, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
        for row in flags:
            a, b = np.searchsorted(bucket, [row["bucket"], row["bucket"] + 1])
            shared[a:b] = np.unpackbits(np.frombuffer(row["shared"], np.uint8))[: b - a]
            hot[a:b] = np.unpackbits(np.frombuffer(row["hot"], np.uint8))[: b - a]
        self.suffix_anchors = np.nonzero((shared & ~hot)[where])[0]
        self.windows = pack.windows(np.nonzero((shared & hot)[where])[0])
        suffixes = self._different(*pack.suffixes(self.suffix_anchors))
        self.suffixes = suffixes + (route.suffix_bucket(suffixes[0]),)
        windows = self._different(*pack.window_records(self.windows))
        self.spread = windows + (route.window_bucket(windows[0]),)

    @staticmethod
    def _different(records: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(different records, the smallest id of each, place of each given record among them, whether its id is larger)."""
        if not len(records):
            return records, ids, np.zeros(0, np.int64), np.zeros(0, bool)
        order = multikey_order(records)
        new = common_prefix(records[order]) < records.shape[1]
        new[0] = True
        at, where = np.nonzero(new)[0], np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], at)
        return records[order[at]], least, where, ids > least[where]

    def blobs(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, bucket, records, ids): kind 0 suffixes, kind 1 windows."""
        for kind, (records, least, _, _, bucket) in enumerate((self.suffixes, self.spread)):
            for b in np.unique(bucket):
                chosen = bucket == b
                # In order, so neighbours share their beginnings and compress well.
                yield kind, int(b), zstandard.compress(records[chosen].tobytes(), 3), zstandard.compress(least[chosen].tobytes(), 1)

    def removed(self, pack: Pack, answers: list[dict]) -> np.ndarray:
        """Whether the window from each byte on also starts in a document with a smaller id."""
        out = np.zeros(len(pack.raw), bool)
        every = (1 << OFFSETS) - 1
        for kind, (records, _, where, larger, bucket) in enumerate((self.suffixes, self.spread)):
            masks = np.zeros(len(records), np.int64)
            for row in answers:
                if row["kind"] == kind:
                    masks[bucket == row["bucket"]] = np.frombuffer(row["masks"], np.int32)
            if not len(where):
                continue
            own = np.where(larger, every, masks[where])
            if kind:
                out[self.windows[own > 0]] = True
                continue
            first, last, anchor = (a[self.suffix_anchors] for a in (pack.first, pack.last, pack.anchors))
            for x in range(OFFSETS):
                start = anchor - x
                out[start[(own >> x & 1 > 0) & (start >= first) & (start <= last)]] = True
        return out


def suffix_rows(packs: DataFrame, flags: DataFrame, route: Route) -> DataFrame:
    """Step 3, out: (`kind`, `bucket`, `pack`, `records`, `ids`)."""
    table = _rows({"kind": pa.int64(), "bucket": pa.int64(), "pack": pa.int64(), "records": pa.binary(), "ids": pa.binary()})

    def sent(pack: pa.Table, flags: pa.Table) -> pa.Table:
        rows = []
        if pack.num_rows and flags.num_rows:
            number = pack.column("pack")[0].as_py()
            rows = [(k, b, number, r, i) for k, b, r, i in Sent(_found(pack), flags.to_pylist(), route).blobs()]
        return table(list(zip(*rows)) if rows else [[]] * 5)

    schema = "kind bigint, bucket bigint, pack bigint, records binary, ids binary"
    return packs.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(sent, schema)


def repeated_rows(suffixes: DataFrame) -> DataFrame:
    """Step 3, back: (`pack`, `kind`, `bucket`, `masks`) for the records of each pack in the order they came."""
    table = _rows({"pack": pa.int64(), "kind": pa.int64(), "bucket": pa.int64(), "masks": pa.binary()})

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        kind, bucket = (k.as_py() for k in key)
        width = LENGTH if kind else RECORD
        parts = [np.frombuffer(zstandard.decompress(i), np.int64) for i in rows.column("ids").to_pylist()]
        records = np.concatenate([np.frombuffer(zstandard.decompress(r), np.uint8).reshape(-1, width) for r in rows.column("records").to_pylist()])
        ids = np.concatenate(parts)
        if kind:
            order = multikey_order(records)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(common_prefix(records[order]) < width)
            masks = (_least(group, ids) < ids).astype(np.int32)
        else:
            masks = repeated_windows(records, ids)
        ends = np.cumsum([len(p) for p in parts])
        packs = rows.column("pack").to_pylist()
        return table([packs, [kind] * len(packs), [bucket] * len(packs), [masks[e - len(p) : e].tobytes() for e, p in zip(ends, parts)]])

    return suffixes.groupBy("kind", "bucket").applyInArrow(compare, "pack bigint, kind bigint, bucket bigint, masks binary")


def results(packs: DataFrame, replies: DataFrame, route: Route, full: bool) -> DataFrame:
    """Step 4."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary, spans array<struct<start bigint, stop bigint>>" if full else ""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    table = _rows(kinds | ({"kept": pa.binary(), "spans": pa.list_(span)} if full else {}))

    def given(pack_rows: pa.Table, replies: pa.Table) -> pa.Table:
        pack = _found(pack_rows)
        if pack is None:
            return table([[]] * (7 if full else 5))
        gone = np.zeros(len(pack.raw), bool)
        rows = replies.to_pylist()
        answers = [r for r in rows if r["masks"] is not None]
        if answers:
            gone = Sent(pack, [r for r in rows if r["shared"] is not None], route).removed(pack, answers)
            covered = 1
            while covered < LENGTH:  # each step doubles the bytes behind a window's start that are marked
                step = min(covered, LENGTH - covered)
                gone[step:] |= gone[:-step].copy()
                covered += step
        out = []
        for key, start, stop in zip(pack.ids.tolist(), pack.starts.tolist(), pack.ends.tolist()):
            own = gone[start:stop]
            kept = pack.raw[start:stop][~own].tobytes()
            edges = np.nonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))[0].reshape(-1, 2)
            row = [None if key == NO_ID else key, stop - start, int(own.sum()), len(edges), hashlib.sha256(kept).hexdigest()]
            out.append(row + ([kept, [{"start": a, "stop": b} for a, b in edges.tolist()]] if full else []))
        return table(list(zip(*out)))

    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(given, schema)


def remove_repeats(
    docs: DataFrame, full: bool = True, id_column: str = "doc_id", text_column: str = "text", pack_bytes: int = PACK,
    hot_packs: int = HOT, bucket: int = BUCKET, max_ranges: int = MAX_RANGES,
) -> DataFrame:
    """Per row: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`; with `full` also `kept` (the remaining bytes)
    and `spans` (the removed runs).

    Null texts count as empty. Rows with the same id do not remove from each other; null ids come after all others and
    not before each other. Texts shorter than LENGTH bytes stay whole. Other columns are not read; empty tables give no
    rows. Ids are bigint.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    packs = stored(pack_documents(rows, pack_bytes), "suffix-packs")
    size, width = packs.agg(F.sum("bytes")).first()[0] or 0, shuffle_width(docs.sparkSession)
    grams = max(width, -(-size // (GRAM_BUCKET * 13)))
    flags = stored(shared_grams(gram_rows(packs, grams), hot_packs), "suffix-flags")
    suffixes, hot = (n or 0 for n in flags.agg(F.sum("n_shared"), F.sum("n_hot")).first())
    buckets = max(width, -(-suffixes // bucket))
    cuts = tuple(splitters(flags.select("leads"), min(buckets, max_ranges)))
    # A hot gram has about 13 windows in a pack.
    route = Route(grams, cuts, max(1, round(buckets / (len(cuts) + 1))), max(width, -(-hot * 13 // bucket)))
    masks = repeated_rows(suffix_rows(packs, flags.drop("leads"), route))
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    replies = masks.select("pack", "bucket", "kind", "masks", nothing("shared", "binary"), nothing("hot", "binary")).unionByName(
        flags.select("pack", "bucket", nothing("kind", "bigint"), nothing("masks", "binary"), "shared", "hot")
    )
    return results(packs, stored(replies, "suffix-replies"), route, full)
