"""Byte-level BPE as a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that BPE produces. It starts as one state that every byte leads back
to, and is built by one gadget per merge (u, v) -> w, in the order of the merges:

- the state that u leads to gets a copy without the arc v, and u leads to the copy from now on (u then v is no longer a
  correct tokenisation);
- every state with an arc u gets an arc w to where v led.

So the state after a token depends on that token only, and the token names it. The gadget copies rows and columns of
the transition table that has states times tokens cells, 2.5e9 for 50,000 merges; here the copies are kept by reference
(`parts` and `born` of a token say which row, which column and when), and a cell is resolved along them and kept in the
table when an encoding first asks for it.

A word has one path through the automaton that spells its bytes. It is found depth first, longest arc first; a
position at which no arc goes on is never tried twice. Texts are split into words first; decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The split of the byte-level pre-tokenizer, and the code points that its older Unicode tables do not
# count among letters or numbers.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
UNASSIGNED = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LETTER, NUMBER = rf"[\p{{L}}--[{UNASSIGNED}]]", rf"[\p{{N}}--[{UNASSIGNED}]]"
# The same split for texts of code points below 256, where the classes are short lists.
LATIN_LETTER, LATIN_NUMBER, LATIN_SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
WORDS_LATIN = re.compile(
    rf"{CONTRACTIONS}| ?[{LATIN_LETTER}]+| ?[{LATIN_NUMBER}]+| ?[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+"
    rf"|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+"
)
WORDS = regex.compile(
    rf"{CONTRACTIONS}| ?{LETTER}+| ?{NUMBER}+| ?[[^\s\p{{L}}\p{{N}}][{UNASSIGNED}]]+|\s+(?!\S)|\s+", regex.V1
)
MAX_WORDS, MAX_CELLS = 120_000, 100_000  # entries of each table that a worker keeps: some 100 MB in all
SHORT = 64  # bytes of a word up to which the ends of paths are shared
PREFIX = 4  # leading bytes that bound the length of an arc
START = -1  # the state before the first token: every arc leaves it


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, labels: dict[int, bytes], merges: list[tuple[bytes, bytes]]):
        self.labels = labels
        self.ids = {label: token for token, label in labels.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.closed: dict[tuple[int, int], int] = {}  # arc -> the merge that took it away
        self.reach: dict[bytes, int] = {}  # the longest label that begins with these bytes
        for label in self.ids:
            self.reach[label[:PREFIX]] = max(len(label), self.reach.get(label[:PREFIX], PREFIX))
        for rank, (left, right) in enumerate(merges):
            self._gadget(rank, self.ids[left], self.ids[right], self.ids[left + right])
        self.table: dict[tuple[int, int], bool] = {}
        # Words and their tokens, in two generations: a full younger one becomes the older.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.ends: dict[tuple[int, bytes], tuple[int, ...] | None] = {}

    def _gadget(self, rank: int, left: int, right: int, merged: int) -> None:
        self.closed[left, right] = rank
        self.parts[merged] = left, right
        self.born[merged] = rank

    def _resolve(self, state: int, token: int) -> bool:
        """Whether the state has the arc after all merges: back through the copies to the arc between two bytes."""
        before = len(self.closed) + 1
        while True:
            if self.closed.get((state, token), before) < before:
                return False
            state_born, token_born = self.born.get(state, -1), self.born.get(token, -1)
            if state_born < 0 and token_born < 0:
                return True
            if token_born > state_born:  # a column: copied from the left part's, after that merge closed its arc
                token, before = self.parts[token][0], token_born + 1
            elif state_born > token_born:  # a row: copied from the right part's, before that merge closed its arc
                state, before = self.parts[state][1], state_born
            else:
                before = state_born
                state, token = self.parts[state][1], self.parts[token][0]

    def step(self, state: int, token: int) -> bool:
        """Whether the state has the arc, from the table or put into it."""
        cell = self.table.get((state, token))
        if cell is None:
            cell = self.table[state, token] = state == START or self._resolve(state, token)
        return cell

    def spell(self, word: bytes) -> tuple[int, ...]:
        """The tokens of the one path that spells the word."""
        whole = self.ids.get(word)
        if whole is not None:
            return (whole,)
        ids, table, size, reach = self.ids, self.table, len(word), self.reach
        path: list[int] = []
        starts: list[int] = [0]
        dead: set[int] = set()
        at, tried = 0, size
        while at < size:
            end = min(tried, at + reach.get(word[at : at + PREFIX], PREFIX))
            found = None
            while end > at:
                if end not in dead:
                    token = ids.get(word[at:end])
                    if token is not None:
                        if not path:
                            found = token
                            break
                        cell = table.get((path[-1], token))
                        if cell is None:
                            cell = self.step(path[-1], token)
                        if cell:
                            found = token
                            break
                end -= 1
            if found is not None:
                path.append(found)
                starts.append(end)
                at, tried = end, size
            else:
                dead.add(at)
                if not path:
                    raise ValueError("bytes outside the vocabulary")
                path.pop()
                tried = starts.pop() - 1
                at = starts[-1]
        return tuple(path)

    def spell_from(self, state: int, rest: bytes) -> tuple[int, ...] | None:
        """The path from a state that spells the rest of a short word, or None. Words share such ends, so they are kept."""
        ids, table = self.ids, self.table
        for end in range(min(len(rest), self.reach.get(rest[:PREFIX], PREFIX)), 0, -1):
            token = ids.get(rest[:end])
            if token is None:
                continue
            cell = table.get((state, token))
            if cell is None:
                cell = self.step(state, token)
            if cell:
                if end == len(rest):
                    return (token,)
                key = token, rest[end:]
                tail = self.ends.get(key, 0)
                if tail == 0:
                    tail = self.ends[key] = self.spell_from(*key)
                if tail is not None:
                    return (token, *tail)
        return None

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of a word of a text, kept for when it comes again."""
        found = self.known.get(word)
        if found is not None:
            return found
        found = self.older.get(word)
        if found is None:
            for kept in (self.table, self.ends):
                if len(kept) >= MAX_CELLS:
                    kept.clear()
            raw = word.encode()
            found = self.spell_from(START, raw) if len(raw) <= SHORT else self.spell(raw)
        if len(word) <= SHORT:
            if len(self.known) >= MAX_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def forget(self) -> None:
        """Empties the tables of words, ends and cells; they fill again as texts are encoded."""
        self.known, self.older, self.ends, self.table = {}, {}, {}, {}


class Tokenizer:
    """Encodes and decodes as the vocabulary file says (byte-level BPE without prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        raw = lambda text: bytes(alphabet[c] for c in text)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        labels = {token: raw(text) for text, token in vocab.items() if text not in self.special}
        self.automaton = MergeAutomaton(labels, [(raw(a), raw(b)) for a, b in merges])
        top = max([*labels, *self.special.values()]) + 1
        self.labels = [b""] * top
        for token, label in labels.items():
            self.labels[token] = label
        for text, token in self.special.items():
            self.labels[token] = text.encode()
        self.names = [str(token) for token in range(top)]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None

    def _plain(self, text: str, ids: list[int]) -> None:
        try:
            text.encode("latin-1")
            split = WORDS_LATIN
        except UnicodeEncodeError:
            split = WORDS
        automaton = self.automaton
        word = automaton.word
        for piece in split.findall(text):
            ids += automaton.known.get(piece) or word(piece)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.marks is None or not any(mark in text for mark in self.special):
            self._plain(text, ids)
            return ids
        for piece in self.marks.split(text):
            if piece in self.special:
                ids.append(self.special[piece])
            else:
                self._plain(piece, ids)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@cache
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, full: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: `doc_id`, `n_tokens`, `ids_sha256` and `decoded_sha256`; with `full` also `ids` and the `decoded` text.

    The hashes are of the decimal ids joined by commas and of the decoded text in UTF-8. Null texts count as empty and
    have no tokens; ids may repeat or be null; other columns are not read. `path` is the vocabulary file, which must be
    at that place on every machine. Texts are taken whole, one row at a time; no shuffle.
    """
    schema = f"doc_id {dict(docs.dtypes)[id_column]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if full else ""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        names = model.names
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(1):
                    ids = model.encode(text.as_py() or "")
                    decoded = model.decode(ids)
                    joined = ",".join(map(names.__getitem__, ids))
                    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (joined, decoded)]
                    rows.append((len(ids), *hashes, *((ids, decoded) if full else ())))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], fields[: 1 + len(columns)])
        model.automaton.forget()  # the worker may go on to other work

    return docs.select(id_column, docs[text_column].cast("string")).mapInArrow(encoded, schema)
