"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into segments of SEGMENT bytes; each is read forwards and backwards by a GRU (reset gate
after the product), and every byte gets a probability per language from the two states there. A document's probability
is the mean over all its bytes. The network is trained by backpropagation through time with Adam on one segment each of a
bounded sample of labelled documents. Prediction runs many segments side by side, one step of all of them per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import bounded_sample, free_name

SEGMENT = 128  # bytes read without a break
HIDDEN = 8  # state of one direction
MAX_TRAIN = 6_000  # labelled documents to learn from, about
STEPS, BATCH, RATE = 260, 192, 0.02
SIDE_BY_SIDE = 4_096  # segments predicted at a time
UNKNOWN = "und"


@dataclass
class Model:
    """`forward` and `backward` hold (input table, recurrent matrix, its bias); `out` and `bias` the labelling layer."""

    labels: list[str]
    forward: list[np.ndarray]
    backward: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.forward, *self.backward, self.out, self.bias]


def new_model(labels: list[str], seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    one = lambda: [draw(3 * HIDDEN, 256), draw(3 * HIDDEN, HIDDEN), np.zeros((3 * HIDDEN, 1), np.float32)]
    return Model(labels, one(), one(), draw(len(labels), 2 * HIDDEN), np.zeros((len(labels), 1), np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=0))
    return x / x.sum(axis=0)


def step(layer: list[np.ndarray], state: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, ...]:
    """One byte of every segment: (new state, update and reset gates, candidate, its recurrent part)."""
    table, recurrent, bias = layer
    given = table.take(bytes_, axis=1)
    held = recurrent @ state
    held += bias
    gates = sigmoid(given[: 2 * HIDDEN] + held[: 2 * HIDDEN])
    update, reset = gates[:HIDDEN], gates[HIDDEN:]
    candidate = np.tanh(given[2 * HIDDEN :] + reset * held[2 * HIDDEN :])
    return candidate + update * (state - candidate), update, reset, candidate, held[2 * HIDDEN :]


def segments(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes [step, segment], length, text) of all segments; the last of a text is filled up with zeros."""
    counts = np.array([-(-len(t) // size) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    raw = b"".join(t + bytes(-len(t) % size) for t in texts)
    table = np.frombuffer(raw, np.uint8).reshape(-1, size)
    lengths = np.full(len(owner), size, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    lengths[last] = sizes[counts > 0] - (counts[counts > 0] - 1) * size
    return np.ascontiguousarray(table.T), lengths, owner


def positions(model: Model, table: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(step, probabilities [label, segment]) from the last byte to the first; beyond a segment's length they are void."""
    size, count = table.shape
    state = np.zeros((HIDDEN, count), np.float32)
    forward = np.empty((size, HIDDEN, count), np.float32)
    for t in range(size):
        state = forward[t] = step(model.forward, state, table[t])[0]
    state = np.zeros((HIDDEN, count), np.float32)
    inside = np.arange(size)[:, None] < lengths
    front, back = model.out[:, :HIDDEN], model.out[:, HIDDEN:]
    for t in reversed(range(size)):
        state = step(model.backward, state, table[t])[0] * inside[t]
        yield t, softmax(front @ forward[t] + back @ state + model.bias)


def predict(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities [label, text] over all bytes of each text; zero for empty texts."""
    pooled = np.zeros((len(model.labels), len(texts)))
    table, lengths, owner = segments(texts)
    for at in range(0, table.shape[1], SIDE_BY_SIDE):
        part = slice(at, at + SIDE_BY_SIDE)
        own = lengths[part]
        total = np.zeros((len(model.labels), len(own)), np.float32)
        for t, found in positions(model, np.ascontiguousarray(table[:, part]), own):
            total += found * (t < own)
        for label, row in enumerate(total):
            pooled[label] += np.bincount(owner[part], row, len(texts))
    return pooled / np.maximum(1, [len(t) for t in texts])


def label_bytes(model: Model, text: str) -> list[str]:
    """The likeliest language of every byte of the text."""
    raw = text.encode()
    table, lengths, _ = segments([raw])
    best = np.zeros(table.shape, np.int64)
    for t, found in positions(model, table, lengths):
        best[t] = found.argmax(axis=0)
    return [model.labels[k] for k in best.T.ravel()[: len(raw)]]


def gradients(model: Model, table: np.ndarray, lengths: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes, and its gradient for each parameter, by backpropagation through time."""
    size, count = table.shape
    inside = (np.arange(size)[:, None] < lengths).astype(np.float32)
    scale = inside * weight / max(1.0, float((inside * weight).sum()))

    def run(layer, order):
        state, states, kept = np.zeros((HIDDEN, count), np.float32), {}, {}
        for t in order:
            new, *gates = step(layer, state, table[t])
            kept[t] = (state, *gates)
            state = states[t] = new * inside[t]
        return states, kept

    ahead, behind = range(size), range(size - 1, -1, -1)
    (front, front_kept), (back, back_kept) = run(model.forward, ahead), run(model.backward, behind)
    grads = [np.zeros_like(p) for p in model.parameters()]
    from_front, from_back, loss = {}, {}, 0.0
    for t in ahead:
        both = np.concatenate((front[t], back[t]))
        found = softmax(model.out @ both + model.bias)
        loss -= float((np.log(found[label, np.arange(count)] + 1e-9) * scale[t]).sum())
        found[label, np.arange(count)] -= 1
        found *= scale[t]
        grads[6] += found @ both.T
        grads[7] += found.sum(axis=1, keepdims=True)
        down = model.out.T @ found
        from_front[t], from_back[t] = down[:HIDDEN], down[HIDDEN:]

    def back_through(layer, kept, from_out, order, into):
        flow = np.zeros((HIDDEN, count), np.float32)
        for t in order:
            state, update, reset, candidate, held = kept[t]
            flow = (flow + from_out[t]) * inside[t]
            d_candidate = flow * (1 - update) * (1 - candidate**2)
            d_update = flow * (state - candidate) * update * (1 - update)
            d_reset = d_candidate * held * reset * (1 - reset)
            d_given = np.concatenate((d_update, d_reset, d_candidate))
            d_held = np.concatenate((d_update, d_reset, d_candidate * reset))
            for row in range(3 * HIDDEN):
                into[0][row] += np.bincount(table[t], d_given[row], 256)
            into[1] += d_held @ state.T
            into[2] += d_held.sum(axis=1, keepdims=True)
            flow = flow * update + layer[1].T @ d_held

    back_through(model.forward, front_kept, from_front, behind, grads[0:3])
    back_through(model.backward, back_kept, from_back, ahead, grads[3:6])
    return loss, grads


def train(samples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 1) -> Model | None:
    """A model from (segment, language) pairs; None without any. Languages weigh alike however often they occur."""
    samples = sorted(s for s in samples if s[0])
    if not samples:
        return None
    labels = sorted({label for _, label in samples})
    model, rng = new_model(labels, seed), np.random.default_rng(seed)
    table, lengths, _ = segments([s[0][:SEGMENT] for s in samples])
    label = np.array([labels.index(s[1]) for s in samples])
    weight = (1 / np.bincount(label, minlength=len(labels)))[label]
    weight = (weight / weight.mean()).astype(np.float32)
    means = [np.zeros_like(p) for p in model.parameters()]
    squares = [np.zeros_like(p) for p in model.parameters()]
    for number in range(1, steps + 1):
        chosen = rng.integers(0, len(label), min(BATCH, len(label)))
        _, grads = gradients(model, table[:, chosen], lengths[chosen], label[chosen], weight[chosen])
        norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - number / (steps + 1))) * np.sqrt(1 - 0.99**number) / (1 - 0.9**number)
        for p, g, mean, square in zip(model.parameters(), grads, means, squares):
            g /= max(1.0, norm)
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            p -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return model


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose language is not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, most: int = MAX_TRAIN) -> Model | None:
    """A model from about `most` rows of `docs` (`doc_id`, `text`, `lang`) that are not held out, one segment of each."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.greatest(F.length("text") - SEGMENT, F.lit(1))).cast("int") + 1
    rows = bounded_sample(known, "doc_id", most).select(F.substring(F.col("text"), place, F.lit(SEGMENT)).alias("piece"), "lang")
    return train([(row.piece.encode()[:SEGMENT], row.lang) for row in rows.collect()])


def language(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (its probability, 0 to 1), from the text alone.

    Null texts, texts without a letter, and every text where there was nothing to learn from are `und` with score 0. Rows
    are judged one by one, so equal texts get equal results. Taken column names get underscores. No shuffle.
    """

    def judge(text: pa.Array) -> pa.Array:
        labels, scores = [UNKNOWN] * len(text), [0.0] * len(text)
        for at in range(0, len(text) if model is not None else 0, 1_000):
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in text.slice(at, 1_000).to_pylist()]
            found = predict(model, [t.encode() for t in texts])
            for k, best in enumerate(found.argmax(axis=0)):
                if texts[k]:
                    labels[at + k], scores[at + k] = model.labels[best], min(1.0, float(found[best, k]))
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    # Marked so that a filter on the result does not run the network a second time.
    judge_once = F.arrow_udf(judge, "lang_pred string, score double").asNondeterministic()
    judged = free_name(docs, "judged")
    names = free_name(docs, "lang_pred"), free_name(docs, "score")
    rows = docs.withColumn(judged, judge_once(F.col(text_column).cast("string")))
    return rows.withColumn(names[0], F.col(judged)["lang_pred"]).withColumn(names[1], F.col(judged)["score"]).drop(judged)
