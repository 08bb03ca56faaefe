"""Removal of repeated passages of words with automata of the phrases that recur.

A word goes if it lies in a window of WINDOW words that also starts earlier: in a document with a smaller id, or further
to the front of the same one. Matching whole texts against all phrases would cost documents times phrases, so both meet
in shards. A window has the anchor where its GRAM-word string with the smallest hash starts (the leftmost of equal ones);
equal windows have equal anchors. A run of consecutive windows with one anchor is a passage of WINDOW to WINDOW + STEPS
words; about one word in seven is an anchor.

1. Documents are packed (about PACK bytes each, compressed) and stored.
2. Each pack counts its anchors' gram hashes and sends them to buckets; a bucket answers each pack with one bit for every
   hash that occurs twice or more in all. The hash only filters; a collision costs work, not correctness.
3. Each pack sends its passages at those anchors, as text, to the shard of their gram, a passage once however many of
   its documents have it. The shard confirms what recurs, word for word, and compiles it into an Aho-Corasick automaton,
   one character a word: the whole passage where its gram has no other passage, else each recurring window. All passages
   of the shard stream through the automaton, and of the places where it finds a phrase all but the first are marked.
   A gram that occurs very often could fill a shard with different passages; its windows are sent one by one instead, to
   the shards of their own hashes.
4. Each pack gets one bit per window back and gives its documents' results.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import shuffle_width, stored
from netsentry.llm.suffix_dedup import NO_ID, pack_documents

WINDOW, GRAM = 20, 8  # words
STEPS = WINDOW - GRAM  # words before an anchor that a window can reach
PACK = 1 << 22
BUCKET = 1_000_000  # gram hashes of a bucket, about
SHARD = 12_000  # passages of a shard, about: its automaton fits a processor cache
HOT = 2_048  # times that a gram occurs from which on its windows are sent one by one; a pack counts to 255
PLANE = 1_000_000  # words that one character tells apart
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))


class Words:
    """The documents of a pack as words in a row, each followed by one space."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        raw = np.frombuffer(zstandard.decompress(row["blob"]) if sizes.sum() else b"", np.uint8)
        letter = ~_SPACE[raw]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        first = np.cumsum(sizes) - sizes
        heads = first[sizes > 0]
        begins[heads] |= letter[heads]
        letters, begins = raw[letter], begins[letter]
        starts = np.nonzero(begins)[0]  # among the letters
        self.sizes = np.diff(np.append(starts, len(letters)))
        per_byte = np.concatenate((np.zeros(1, np.int64), np.cumsum(letter)))
        self.firsts = np.searchsorted(starts, per_byte[first])  # each document's first word
        self.counts = np.diff(np.append(self.firsts, len(starts)))
        self.at = starts + np.arange(len(starts))  # where a word begins in `text`
        self.letters = letters
        self._hash(letters, starts)

    @cached_property
    def text(self) -> np.ndarray:
        """All words, each followed by one space."""
        text = np.full(len(self.letters) + len(self.sizes), 32, np.uint8)
        text[np.arange(len(self.letters)) + np.repeat(np.arange(len(self.sizes)), self.sizes)] = self.letters
        return text

    def _hash(self, letters: np.ndarray, starts: np.ndarray) -> None:
        """Anchors (`anchor`, `owner`) with their runs of windows (`low` to `high`) and gram hashes (`keys`)."""
        self.anchor = self.owner = self.low = self.high = np.zeros(0, np.int64)
        self.keys = np.zeros(0, np.uint64)
        if len(starts) < WINDOW:
            return
        powers = np.cumprod(np.full(len(letters), _BASE, np.uint64))
        prefix = _sums(_LETTERS[letters] * powers)
        back = np.cumprod(np.full(len(letters), _BACK, np.uint64))
        one = _mix((prefix[starts + self.sizes] - prefix[starts]) * back[starts])
        two = _mix(one[:-1] * _PAIR + one[1:])
        four = _mix(two[:-2] * _PAIR + two[2:])
        gram = _mix(four[:-4] * _PAIR + four[4:])
        key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        for step in (1, 2, 4):
            key = np.minimum(key[:-step], key[step:])
        windows = len(starts) - WINDOW + 1
        key = np.minimum(key[:windows], key[STEPS - 7 :][:windows])
        anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)[:windows]
        place = np.nonzero(np.arange(windows) + WINDOW <= (self.firsts + self.counts)[owner])[0]
        anchor, owner = anchor[place], owner[place]
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        at = np.nonzero(new)[0]
        self.anchor, self.owner, self.low = anchor[at], owner[at], place[at]
        self.high = place[np.append(at[1:], len(place)) - 1] if len(at) else place
        self.keys = _mix(gram[self.anchor])

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, hash within it, count up to 255) of each different gram in order; each anchor's place among them."""
        bucket = (self.keys >> np.uint64(40)) % np.uint64(buckets)
        whole = (bucket << np.uint64(32)) | (self.keys & np.uint64(0xFFFFFFFF))
        found, where, counts = np.unique(whole, return_inverse=True, return_counts=True)
        bucket = (found >> np.uint64(32)).astype(np.int64)
        return bucket, (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, 255).astype(np.uint8), where

    def passage(self, first: int, last: int) -> bytes:
        """The words from one to another, with single spaces."""
        return self.text[self.at[first] : self.at[last] + self.sizes[last]].tobytes()


def _table(columns: dict[str, pa.DataType], rows: list) -> pa.Table:
    lists = list(zip(*rows)) if rows else [[]] * len(columns)
    return pa.table({n: pa.array(lists[k], t) for k, (n, t) in enumerate(columns.items())})


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of each run of an ascending array."""
    cuts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    yield from zip(bucket[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist())


def gram_rows(packs: DataFrame, buckets: int) -> DataFrame:
    """Step 2, out: (`bucket`, `pack`, `grams`, `counts`)."""
    columns = {"bucket": pa.int64(), "pack": pa.int64(), "grams": pa.binary(), "counts": pa.binary()}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bucket, gram, count, _ = Words(row).grams(buckets)
                rows = [(b, row["pack"], gram[i:j].tobytes(), zstandard.compress(count[i:j].tobytes())) for b, i, j in _pieces(bucket)]
                yield from _table(columns, rows).to_batches()

    return packs.mapInArrow(sent, "bucket bigint, pack bigint, grams binary, counts binary")


def recurring_grams(grams: DataFrame, hot: int) -> DataFrame:
    """Step 2, back: (`pack`, `bucket`, `recurs`, `hot`, `n`, `n_hot`): a bit for each gram that the pack sent, and how
    many bits are set."""
    columns = {"pack": pa.int64(), "bucket": pa.int64(), "recurs": pa.binary(), "hot": pa.binary(), "n": pa.int64(), "n_hot": pa.int64()}

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sent = [np.frombuffer(g, np.uint32) for g in rows.column("grams").to_pylist()]
        counts = [np.frombuffer(zstandard.decompress(c), np.uint8) for c in rows.column("counts").to_pylist()]
        _, where = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts))[where]
        out, at = [], 0
        for pack, own in zip(rows.column("pack").to_pylist(), sent):
            part = total[at : at + len(own)]
            at += len(own)
            recurs, often = part > 1, part >= hot
            if recurs.any():
                out.append((pack, key[0].as_py(), np.packbits(recurs).tobytes(), np.packbits(often).tobytes(), int(recurs.sum()), int(often.sum())))
        return _table(columns, out)

    return grams.groupBy("bucket").applyInArrow(compare, "pack bigint, bucket bigint, recurs binary, hot binary, n bigint, n_hot bigint")


class Sent:
    """The passages that a pack sends in step 3, in an order that step 4 finds again.

    A passage has a key of 64 bits that decides its shard, the first window and how many of them; each different text is
    sent once, with the id and place of its first occurrence in the pack."""

    def __init__(self, words: Words, flags: list[dict], buckets: int, shards: int):
        bucket, _, _, where = words.grams(buckets)
        recurs, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
        for row in flags:
            a, b = np.searchsorted(bucket, [row["bucket"], row["bucket"] + 1])
            recurs[a:b] = np.unpackbits(np.frombuffer(row["recurs"], np.uint8))[: b - a]
            hot[a:b] = np.unpackbits(np.frombuffer(row["hot"], np.uint8))[: b - a]
        whole, single = np.nonzero((recurs & ~hot)[where])[0], np.nonzero((recurs & hot)[where])[0]
        counts = (words.high - words.low + 1)[single]
        each = np.repeat(single, counts)
        steps = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        low = np.concatenate((words.low[whole], words.low[each] + steps))
        high = np.concatenate((words.high[whole], words.low[each] + steps))
        owner = np.concatenate((words.owner[whole], words.owner[each]))
        anchor = np.concatenate((words.anchor[whole], words.anchor[each])) - low
        ids, place = words.ids[owner], low - words.firsts[owner]
        self.low, self.high = low, high
        order = np.lexsort((place, ids))  # the first occurrence of a text comes first
        seen: dict[bytes, int] = {}
        self.where = np.zeros(len(low), np.int64)  # of each passage, its text's place among the different ones
        firsts = []
        ends = high + WINDOW - 1
        for k in order.tolist():
            text = words.passage(low[k], ends[k])
            number = seen.setdefault(text, len(seen))
            self.where[k] = number
            if number == len(firsts):
                firsts.append(k)
        firsts = np.array(firsts, np.int64)
        self.texts = list(seen)
        self.ids, self.places, self.anchor = ids[firsts], place[firsts], anchor[firsts]
        self.later = (ids != self.ids[self.where]) | (place != self.places[self.where]) if len(low) else np.zeros(0, bool)
        spread = np.concatenate((words.keys[whole], np.zeros(len(each), np.uint64)))[firsts]
        for k in np.nonzero(firsts >= len(whole))[0].tolist():  # single windows go by their own hash
            spread[k] = int.from_bytes(hashlib.blake2b(self.texts[k], digest_size=8).digest(), "little")
        self.shard = (_mix(spread) % np.uint64(shards)).astype(np.int64)
        self.order = np.argsort(self.shard, kind="stable")

    def rows(self, pack: int) -> Iterator[tuple]:
        """(`shard`, `pack`, `texts`, `ids`, `places`, `anchors`)."""
        squeeze = lambda array, kind: zstandard.compress(array.astype(kind).tobytes(), 1)
        for shard, i, j in _pieces(self.shard[self.order]):
            own = self.order[i:j]
            texts = zstandard.compress(b"\n".join(self.texts[k] for k in own), 6)
            yield shard, pack, texts, squeeze(self.ids[own], np.int64), squeeze(self.places[own], np.int64), self.anchor[own].astype(np.uint8).tobytes()

    def removed(self, answers: list[dict]) -> np.ndarray:
        """The windows that start earlier elsewhere, too."""
        masks, sorted_ = np.zeros(len(self.texts), np.int64), self.shard[self.order]
        for row in answers:
            a, b = np.searchsorted(sorted_, [row["shard"], row["shard"] + 1])
            masks[self.order[a:b]] = np.frombuffer(row["masks"], np.uint16)
        if not len(self.where):
            return np.zeros(0, np.int64)
        own = np.where(self.later, (1 << (STEPS + 1)) - 1, masks[self.where])
        starts = [(self.low + k)[(own >> k & 1 > 0) & (self.low + k <= self.high)] for k in range(STEPS + 1)]
        return np.concatenate(starts)


def phrase_rows(packs: DataFrame, flags: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Step 3, out: (`shard`, `pack`, `texts`, `ids`, `places`, `anchors`)."""
    columns = {"shard": pa.int64(), "pack": pa.int64()} | {n: pa.binary() for n in ("texts", "ids", "places", "anchors")}

    def sent(pack: pa.Table, flags: pa.Table) -> pa.Table:
        if not pack.num_rows or not flags.num_rows:
            return _table(columns, [])
        row = pack.slice(0, 1).to_pylist()[0]
        return _table(columns, list(Sent(Words(row), flags.to_pylist(), buckets, shards).rows(row["pack"])))

    schema = "shard bigint, pack bigint, texts binary, ids binary, places binary, anchors binary"
    return packs.groupBy("pack").cogroup(flags.groupBy("pack")).applyInArrow(sent, schema)


def coded(texts: list[bytes], plane: int = PLANE) -> tuple[list[str], int]:
    """The texts with one character for each word, or two where the words are more than `plane`; how many."""
    table: dict[bytes, int] = {}
    lines = [[table.setdefault(w, len(table)) for w in text.split(b" ")] for text in texts]
    # Behind the surrogates, which are no characters, and with an alphabet of its own for the second of two.
    letter = lambda n: chr(n + 1 if n < 0xD7FF else n + 0x801)
    if len(table) <= plane:
        words = [letter(n) for n in range(len(table))]
        return ["".join([words[n] for n in line]) for line in lines], 1
    half = plane // 2
    return ["".join([letter(n // half) + letter(half + n % half) for n in line]) for line in lines], 2


def later_windows(texts: list[bytes], ids: np.ndarray, places: np.ndarray, anchors: list[int], plane: int = PLANE) -> np.ndarray:
    """For each passage the windows (bit k: the one that starts k words in) that also start earlier among the passages.

    `ids` and `places` tell where a passage's first window starts, `anchors` how many words in its gram does."""
    numbers: dict[bytes, int] = {}
    which = np.fromiter((numbers.setdefault(t, len(numbers)) for t in texts), np.int64, len(texts))
    often = np.bincount(which)
    # The first occurrence of each text; a phrase in it is first there or in another text.
    order = np.lexsort((places, ids, which))
    heads = order[np.nonzero(np.diff(which[order], prepend=-1))[0]]
    lines, width = coded(list(numbers), plane)
    window = WINDOW * width
    grams = [line[anchors[k] * width : (anchors[k] + GRAM) * width] for line, k in zip(lines, heads.tolist())]
    passages = Counter(grams)
    windows: Counter[str] = Counter()
    phrases = set()
    for line, gram, count in zip(lines, grams, often.tolist()):
        if passages[gram] > 1:
            for k in range(0, len(line) - window + 1, width):
                windows[line[k : k + window]] += count
        elif count > 1:
            phrases.add(line)
    phrases.update(w for w, n in windows.items() if n > 1)
    if not phrases:
        return np.zeros(len(texts), np.uint16)
    automaton = ahocorasick.Automaton()
    for number, phrase in enumerate(phrases):
        automaton.add_word(phrase, number)
    automaton.make_automaton()
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    hits = [(number, row, end) for row, line in enumerate(lines) for end, number in automaton.iter(line)]
    number, row, end = np.array(hits, np.int64).reshape(-1, 3).T
    offset = (end + 1 - lengths[number]) // width
    bits = ((1 << (lengths[number] // width - WINDOW + 1)) - 1) << offset
    every, rest = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64)
    np.bitwise_or.at(every, row, bits)
    own, starts = ids[heads][row], places[heads][row] + offset
    order = np.lexsort((starts, own, number))
    new = np.nonzero(np.diff(number[order], prepend=-1))[0]
    first = np.repeat(order[new], np.diff(np.append(new, len(order))))  # of each phrase, in order
    later = order[(own[order] != own[first]) | (starts[order] != starts[first])]
    np.bitwise_or.at(rest, row[later], bits[later])
    is_head = (ids == ids[heads][which]) & (places == places[heads][which])
    return np.where(is_head, rest[which], every[which]).astype(np.uint16)


def marked_rows(phrases: DataFrame) -> DataFrame:
    """Step 3, back: (`pack`, `shard`, `masks`), 16 bits for each passage in the order that the pack sent them."""
    columns = {"pack": pa.int64(), "shard": pa.int64(), "masks": pa.binary()}

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        opened = lambda name, kind: [np.frombuffer(zstandard.decompress(c), kind) for c in rows.column(name).to_pylist()]
        texts = [zstandard.decompress(t).split(b"\n") for t in rows.column("texts").to_pylist()]
        anchors = b"".join(rows.column("anchors").to_pylist())
        ids, places = np.concatenate(opened("ids", np.int64)), np.concatenate(opened("places", np.int64))
        masks = later_windows([t for part in texts for t in part], ids, places, list(anchors))
        ends = np.cumsum([len(part) for part in texts])
        out = [(pack, key[0].as_py(), masks[e - len(t) : e].tobytes()) for pack, t, e in zip(rows.column("pack").to_pylist(), texts, ends)]
        return _table(columns, out)

    return phrases.groupBy("shard").applyInArrow(compare, "pack bigint, shard bigint, masks binary")


def results(packs: DataFrame, replies: DataFrame, buckets: int, shards: int, full: bool) -> DataFrame:
    """Step 4."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    columns = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
    if full:
        schema += ", kept string, spans array<struct<start bigint, stop bigint>>"
        columns |= {"kept": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}

    def given(pack: pa.Table, replies: pa.Table) -> pa.Table:
        if not pack.num_rows:
            return _table(columns, [])
        words, rows = Words(pack.slice(0, 1).to_pylist()[0]), replies.to_pylist()
        n = len(words.at)
        gone = np.zeros(n, bool)
        if answers := [r for r in rows if r["masks"] is not None]:
            windows = Sent(words, [r for r in rows if r["recurs"] is not None], buckets, shards).removed(answers)
            depth = np.bincount(windows, minlength=n + WINDOW) - np.bincount(windows + WINDOW, minlength=n + WINDOW)[: n + WINDOW]
            gone = np.cumsum(depth)[:n] > 0
        stays = np.repeat(~gone, words.sizes + 1)
        begins = np.append(words.at, len(words.text))
        out = []
        for key, first, count in zip(words.ids.tolist(), words.firsts.tolist(), words.counts.tolist()):
            a, b = begins[first], begins[first + count]
            kept = words.text[a:b][stays[a:b]].tobytes()[:-1]
            own = gone[first : first + count]
            row = [None if key == NO_ID else key, count, int(own.sum()), hashlib.sha256(kept).hexdigest()]
            if full:
                edges = np.nonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))[0].reshape(-1, 2)
                row += [kept.decode(), [{"start": a, "stop": b} for a, b in edges.tolist()]]
            out.append(row)
        return _table(columns, out)

    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(given, schema)


def remove_phrases(
    docs: DataFrame, full: bool = True, id_column: str = "doc_id", text_column: str = "text", pack_bytes: int = PACK, hot: int = HOT,
    shard_passages: int = SHARD,
) -> DataFrame:
    """Per row: `doc_id`, `n_words`, `n_removed`, `kept_sha256`; with `full` also `kept` (the remaining words, joined by
    one space) and `spans` (the removed runs, in words).

    Words are `[^\\x20\\x09-\\x0D]+`; null texts count as empty, texts of fewer than WINDOW words stay whole. Rows with the
    same id count as one document: a window is earlier than another of that id if it starts further to the front, and
    windows at the same place do not remove each other. Null ids are one id after all others. Other columns are not
    read; empty tables give no rows. Ids are bigint.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    packs = stored(pack_documents(rows, pack_bytes).drop("sample"), "phrase-packs")
    width = shuffle_width(docs.sparkSession)
    size = packs.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(width, -(-size // (BUCKET * 40)))
    flags = stored(recurring_grams(gram_rows(packs, buckets), hot), "phrase-flags")
    sums = flags.agg(F.sum("n"), F.sum("n_hot")).first()
    shards = max(width, -(-((sums[0] or 0) + STEPS * (sums[1] or 0)) // shard_passages))
    flags = flags.drop("n", "n_hot")
    masks = marked_rows(phrase_rows(packs, flags, buckets, shards))
    replies = masks.unionByName(flags, allowMissingColumns=True)
    return results(packs, stored(replies, "phrase-replies"), buckets, shards, full)
