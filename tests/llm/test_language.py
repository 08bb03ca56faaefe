import math
import random
import zlib

import numpy as np
import pytest

from netsentry.llm import language as L

WORDS = {
    "en": "the of and thing ing that with her", "de": "der und nicht ist schön für keit ung", "fr": "le dans où être élan que çà des",
}


def sentence(rng, lang, count):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(count))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return L.train([(sentence(rng, lang, 30).encode(), lang) for lang in WORDS for _ in range(60)], steps=120)


def test_gradient_equals_differences():
    model = L.new_model(["a", "b"])
    table, lengths, _ = L.segments([b"hello world", b"xyz", b"abcdef"], 16)
    label, weight = np.array([0, 1, 1]), np.ones(3, np.float32)
    _, grads = L.gradients(model, table, lengths, label, weight)
    for number, cell in ((0, (3, 104)), (1, (5, 2)), (1, (20, 3)), (2, (17, 0)), (3, (9, 120)), (4, (18, 1)), (5, (20, 0)), (6, (1, 9)), (7, (0, 0))):
        array = model.parameters()[number]
        held, losses = array[cell], []
        for step in (0.01, -0.01):
            array[cell] = held + step
            losses.append(L.gradients(model, table, lengths, label, weight)[0])
        array[cell] = held
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(grads[number][cell], abs=2e-4)


def plain_states(layer, raw):
    """States after each byte, number by number."""
    table, recurrent, bias = (p.tolist() for p in layer)
    size, out = L.HIDDEN, []
    state = [0.0] * size
    squash = lambda x: 1 / (1 + math.exp(-x))
    for byte in raw:
        held = [sum(w * s for w, s in zip(row, state)) + b[0] for row, b in zip(recurrent, bias)]
        given = [row[byte] for row in table]
        new = []
        for k in range(size):
            update, reset = squash(given[k] + held[k]), squash(given[size + k] + held[size + k])
            candidate = math.tanh(given[2 * size + k] + reset * held[2 * size + k])
            new.append(update * state[k] + (1 - update) * candidate)
        state = new
        out.append(state)
    return out


def plain_probabilities(model, raw):
    """Mean over all bytes of the label probabilities, segment by segment."""
    total = [0.0] * len(model.labels)
    for at in range(0, len(raw), L.SEGMENT):
        segment = raw[at : at + L.SEGMENT]
        behind = plain_states(model.backward, segment[::-1])[::-1]
        for front, back in zip(plain_states(model.forward, segment), behind):
            logits = [sum(w * s for w, s in zip(row, front + back)) + b[0] for row, b in zip(model.out.tolist(), model.bias.tolist())]
            powers = [math.exp(x) for x in logits]
            total = [t + p / sum(powers) for t, p in zip(total, powers)]
    return [t / max(1, len(raw)) for t in total]


def test_prediction_equals_a_plain_forward_pass(model):
    texts = ["der und", "", "le dans où être " * 20, "x", "a" * L.SEGMENT, "thing \x00 ing " * 15]
    for one in (model, L.new_model(["a", "b", "c"], seed=5)):
        found = L.predict(one, [t.encode() for t in texts])
        for k, text in enumerate(texts):
            assert list(found[:, k]) == pytest.approx(plain_probabilities(one, text.encode()), abs=1e-4)


def test_held_out_accuracy(model):
    rng = random.Random(2)
    for lang in WORDS:
        texts = [sentence(rng, lang, rng.randrange(3, 200)) for _ in range(40)]
        best = L.predict(model, [t.encode() for t in texts]).argmax(axis=0)
        assert np.mean([model.labels[k] == lang for k in best]) >= 0.95


def test_batches_do_not_change_a_prediction(model):
    rng = random.Random(3)
    texts = [sentence(rng, "fr", n).encode() for n in (1, 5, 40, 300)] + [b"", b"x" * L.SEGMENT, b"y" * (L.SEGMENT + 1)]
    together = L.predict(model, texts)
    alone = np.hstack([L.predict(model, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    assert together[:, 4].sum() == 0 and np.allclose(np.delete(together, 4, axis=1).sum(axis=0), 1, atol=1e-4)


def test_every_byte_has_a_label(model):
    rng = random.Random(4)
    text = sentence(rng, "de", 60) + " " + sentence(rng, "en", 60)
    labels = L.label_bytes(model, text)
    raw = text.encode()
    assert len(labels) == len(raw)
    assert labels[: len(raw) // 3].count("de") > 0.8 * (len(raw) // 3) and labels[-len(raw) // 3 :].count("en") > 0.8 * (len(raw) // 3)


def test_training_is_the_same_again():
    samples = [(b"abc def", "x"), (b"xyz", "y")] * 5
    one, two = L.train(samples, steps=5), L.train(list(reversed(samples)), steps=5)
    assert all((a == b).all() for a, b in zip(one.parameters(), two.parameters()))
    assert L.train([]) is None and L.train([(b"", "x")]) is None


def test_query_on_the_tables(spark):
    from netsentry.llm.catalog import op6_language

    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op6_language(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_hostile_rows(hostile, nothing, model):
    found = L.language(hostile, model)
    assert found.columns == [*hostile.columns, "lang_pred", "_score"]  # `score` is taken
    rows = found.collect()
    assert len(rows) == hostile.count()
    for r in rows:
        unknown = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == L.UNKNOWN) == unknown
        assert 0 <= r._score <= 1
    assert {r.lang_pred for r in L.language(hostile, None).collect()} == {L.UNKNOWN}
    assert L.learn(nothing) is None and L.language(nothing, None).count() == 0
    assert L.learn(hostile).labels
