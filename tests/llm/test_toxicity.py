import random
import zlib

import numpy as np
import pytest

from netsentry.llm import toxicity as X

FOUL = ["idiot", "moron", "scum", "worthless", "pathetic"]


def text(rng, foul=None, count=40):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ing", "ha", "nd"]) for _ in range(rng.randrange(1, 4))) for _ in range(count)]
    if foul:
        words.insert(rng.randrange(len(words)), foul)
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    samples = [(text(rng), 0) for _ in range(300)] + [(text(rng, rng.choice(FOUL)), 1) for _ in range(120)]
    return X.train(samples)


def brute_kernel(a, b):
    """Over all pairs of three places within the span."""

    def weights(unit):
        found = X.encode([unit])[0].tolist()
        out = {}
        for i in range(len(found)):
            for j in range(i + 1, len(found)):
                for k in range(j + 1, len(found)):
                    if k - i <= X.SPAN and X.EDGE not in found[i + 1 : k]:
                        key = found[i], found[j], found[k]
                        out[key] = out.get(key, 0.0) + X.DECAY ** (k - i - 2)
        return out, X.norms(np.array([len(found)]))[0]

    (x, n), (y, m) = weights(a), weights(b)
    return sum(w * y.get(k, 0.0) for k, w in x.items()) / n / m


def test_table_sums_equal_the_kernel():
    for other in ("idiot", "idxiot", "i*d*i*o*t", "i d i o t", "idiotic", "thing", "IDIOT!!", "réeux", "é"):
        table = np.zeros(X.CLASSES**3, np.float32)
        for code, weight in X.features("idiot").items():
            table[code] = weight
        assert X.unit_values(table, [other])[0].max() == pytest.approx(brute_kernel(other, "idiot"), abs=1e-5)


def test_units_end_at_white_space():
    values, first, owner = X.unit_values(np.zeros(X.CLASSES**3, np.float32), ["ab cd", "", "ef g h ij"])
    assert len(values) == len(first) == len(owner) and set(owner) == {0, 1, 2}
    assert X.unit_at("ab cd", 0) == "ab" and X.unit_at("ab cd", 3) == "cd"


def test_held_out_accuracy(model):
    rng = random.Random(2)
    clean = model.score([text(rng) for _ in range(200)])
    foul = model.score([text(rng, rng.choice(FOUL)) for _ in range(200)])
    assert (clean >= 0.5).mean() <= 0.02 and (foul >= 0.5).mean() >= 0.95


@pytest.mark.parametrize("change", ["{}!!", "({})", "Inserted"])
def test_changed_insults(model, change):
    rng = random.Random(3)
    for foul in FOUL:
        other = "*".join(foul) if change == "Inserted" else change.format(foul.upper())
        assert model.score([text(rng, other)])[0] >= 0.5
    assert model.worst_unit(text(rng, "m-o-r-o-n")) == "m-o-r-o-n"


def test_gaps_are_nearer_than_other_words(model):
    rng = random.Random(4)
    plain = text(rng)
    assert model.score([plain + " idxiot"])[0] > model.score([plain + " thererha"])[0]


def test_batches_do_not_change_a_score(model):
    rng = random.Random(5)
    texts = [text(rng), "", text(rng, "scum"), " \n", "i d i o t", "x"]
    together = model.score(texts)
    assert np.allclose(together, np.concatenate([model.score([t]) for t in texts]), atol=1e-6)


def test_one_label_gives_no_model():
    assert X.train([]) is None and X.train([("a b", 0), ("c", 0)]) is None
    assert X.train([("bad word", 1), ("good word", 0)]) is not None


def test_query_on_the_tables(spark):
    from netsentry.llm.catalog import op7_toxicity

    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op7_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_hostile_rows(spark, hostile, nothing, model):
    found = X.toxicity(hostile, model)
    assert found.columns == [*hostile.columns, "_score", "predicted"]
    rows = found.collect()
    assert len(rows) == hostile.count() and all(0 <= r._score <= 1 and r.predicted == (r._score >= 0.5) for r in rows)
    assert {r._score for r in X.toxicity(hostile, None).collect()} == {0.0}
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, None), (6, 1, 0), (None, 1, 1), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert X.learn(hostile, labels) is not None
    assert X.learn(nothing, labels.limit(0)) is None and X.toxicity(nothing, None).count() == 0


def test_the_norm_grows_with_the_root_of_the_length():
    table = np.ones(X.CLASSES**3, np.float32)
    values = [X.unit_values(table, ["a" * n])[0][0] / n**0.5 for n in (100, 4_000, 5_000, 20_000, 100_000)]
    assert max(values) < 1.02 * min(values)


def test_styled_letters_have_the_class_of_plain_ones():
    styled = "".join(chr(0x1D400 + ord(c) - ord("A")) for c in "INSULT") + " " + "".join(chr(0xFF41 + ord(c) - ord("a")) for c in "word")
    assert (X.encode([styled])[0] == X.encode(["INSULT word"])[0]).all()
    assert (X.encode(["\U0001d7d0a"])[0] == X.encode(["2a"])[0]).all() and len(X.encode(["\U0001f600"])[0]) == len(X.encode([""])[0])
