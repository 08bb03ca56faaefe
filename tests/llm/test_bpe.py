import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from netsentry.llm.bpe import MergeAutomaton, Tokenizer, encode_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "b", "aa", "he", "the", " ", "  ", "\n", "é", "😀", "1", "23", "'s", "'ll", "!", "<|endoftext|>", "՘", "　",
    "\x1c", "\x85", "ß", "日本", "ZZZZZ", "\x00", "=", "----", "\xa0", "²", "ª", "\x1f",
]


@pytest.fixture(scope="module")
def ours():
    return Tokenizer(PATH)


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


def test_equals_the_library_on_random_texts(ours, theirs):
    rng = random.Random(1)
    latin = [p for p in PIECES if max(p) < "Ā"]
    for k in range(4000):
        text = "".join(rng.choice(latin if k % 2 else PIECES) for _ in range(rng.randrange(25)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_random_letters_and_long_words(ours, theirs):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabeehilnorstt") for _ in range(rng.randrange(1, 90))) for _ in range(1500)]
    for text in [*texts, "a" * 2000, "ab" * 1000, "the" * 500]:
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_automaton_has_exactly_the_tokenisations():
    """All words of a small alphabet against merging by rank."""
    merges = [(b"a", b"b"), (b"a", b"a"), (b"aa", b"ab"), (b"b", b"a"), (b"ab", b"ab")]
    labels = dict(enumerate([b"a", b"b", *(x + y for x, y in merges)]))
    automaton = MergeAutomaton(labels, merges)

    def merged(word):
        parts = [word[k : k + 1] for k in range(len(word))]
        for left, right in merges:
            k = 0
            while k + 1 < len(parts):
                if (parts[k], parts[k + 1]) == (left, right):
                    parts[k : k + 2] = [left + right]
                k += 1
        return parts

    for size in range(1, 11):
        for number in range(2**size):
            word = bytes(b"ab"[number >> k & 1] for k in range(size))
            want = merged(word)
            assert [labels[t] for t in automaton.spell(word)] == want, word
            assert [labels[t] for t in automaton.word(word.decode())] == want, word


def test_hostile_rows(hostile, nothing, ours):
    rows = encode_documents(hostile, PATH).collect()
    texts = sorted(r.text or "" for r in hostile.collect())
    assert sorted(r.decoded for r in rows) == texts
    for row in rows:
        ids = ours.encode(row.decoded)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    assert encode_documents(nothing, PATH, full=False).count() == 0
