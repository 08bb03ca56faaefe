"""Toxicity by a support vector machine over a gapped subsequence kernel, with Nystroem landmarks.

The kernel compares two units (words with their ends, or characters set apart by single spaces) by the subsequences of
three letters that they share within a span: each occurrence counts DECAY to the power of its gaps. Inserted letters widen
the gaps but leave the subsequences; other inserted characters do not count at all, so "i*d-i o t" equals "idiot". The machine is trained in the Nystroem
space of some landmark units. Its decision function is a sum over a unit's subsequences of one weight each, so that whole
texts are scored by table look-ups, all units of many documents at once. A document scores by its two worst units: a word
that is foul in one place and harmless in another tells less alone than twice.

Labels belong to documents: training seeks the unit of each toxic document that explains the label, beginning with units
frequent in toxic documents and rare in others, and takes the worst units of clean documents as counter-examples. A part
of the sample that the machine has not seen turns decision values into probabilities.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import bounded_sample, free_name

CLASSES, GAP, EDGE = 64, 0, 1  # character classes: skipped characters, ends of a unit, and letters from 2 on
SPAN, DECAY = 6, 0.7  # farthest distance of the last from the first character; weight of one skipped character
LANDMARKS = 192
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 2_500, 4_000, 20_000  # documents to learn from, about, and their length at most
ROUNDS, PENALTY = 4, 1e-4
STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN + 1 - a)]
WORD = re.compile(r"[^\x00-\x20\x85\xa0]+")
#: Digits that stand for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


@cache
def point_class(point: int) -> int:
    """The class of a code point: white space is an edge, a-z have one each, other letters share. Styled letters, inside
    the basic plane and beyond it, have that of the plain letter that they are compatible with."""
    char = chr(point)
    if point > 0xFFFF or char.isalpha():
        char = unicodedata.normalize("NFKC", char)[:1]
    char = LOOKALIKE.get(char, char)
    low = char.lower()[:1]
    if "a" <= low <= "z":
        return 2 + ord(low) - ord("a")
    if char.isspace():
        return EDGE
    return 28 + ord(low) % 36 if char.isalpha() else GAP


@cache
def classes() -> np.ndarray:
    """The classes of the basic plane."""
    return np.array([point_class(point) for point in range(1 << 16)], np.uint8)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each character that counts, place of each in the line, place at which each text begins).

    The line is the texts with an edge before, between and after them. White space between single characters, and other
    characters that are no letters, are left out inside a unit; at its ends they belong to the edge.
    """
    line = "\n" + "\n".join(texts) + "\n"
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = classes()[np.minimum(points, 0xFFFF)]
    beyond = np.nonzero(points > 0xFFFF)[0]
    if len(beyond):
        each, which = np.unique(points[beyond], return_inverse=True)
        found[beyond] = np.array([point_class(point) for point in each.tolist()], np.uint8)[which]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    edges = np.nonzero(found == EDGE)[0]
    tokens = np.diff(edges) - 1  # characters between edges
    inner = np.zeros(len(edges), bool)
    inner[1:-1] = (tokens[:-1] == 1) & (tokens[1:] == 1)
    inner[np.searchsorted(edges, starts)] = False  # texts stay apart
    found[edges[inner]] = GAP
    kept = np.nonzero(found != GAP)[0]
    return found[kept], kept, starts[:-1]


def norms(size: np.ndarray) -> np.ndarray:
    """The norm that units of these sizes (ends included) are divided by; from SPAN on its square grows by the same with
    each character."""
    square = np.ones(len(size))
    for a, b in STEPS:
        square += DECAY ** (2 * (a + b - 2)) * np.maximum(0, size - a - b)
    return np.sqrt(square)


def unit_values(table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each unit, its first place, text it belongs to): sums of `table` over its subsequences, normed."""
    found, kept, starts = encode(texts)
    edge = found == EDGE
    before = np.cumsum(edge)
    first = np.nonzero(edge)[0]
    wide = found.astype(np.int32)
    total = np.zeros(len(found), np.float32)
    size = len(found)
    for a in range(1, SPAN):
        head = (wide[: size - a] * CLASSES + wide[a:]) * CLASSES if size > a else None
        for b in range(1, SPAN + 1 - a):
            span = a + b
            if size <= span:
                continue
            whole = before[span - 1 : size - 1] == before[: size - span]  # no edge inside
            total[: size - span] += np.float32(DECAY ** (span - 2)) * table[head[: size - span] + wide[span:]] * whole
    values = np.add.reduceat(total, first)[:-1] if len(first) > 1 else np.zeros(0, np.float32)
    units = np.diff(first) + 1
    place = kept[first[:-1]]
    owner = np.searchsorted(starts, place, "right") - 1
    return values / norms(units), place, owner


def features(unit: str) -> dict[int, float]:
    """The unit's subsequences and their weights, normed."""
    found = encode([unit])[0].astype(int).tolist()
    out: dict[int, float] = {}
    for i in range(len(found)):
        for a, b in STEPS:
            if i + a + b < len(found) and EDGE not in found[i + 1 : i + a + b]:
                three = found[i], found[i + a], found[i + a + b]
                code = (three[0] * CLASSES + three[1]) * CLASSES + three[2]
                out[code] = out.get(code, 0.0) + DECAY ** (a + b - 2)
    norm = norms(np.array([len(found)]))[0]
    return {code: weight / norm for code, weight in out.items()}


def matrix(units: list[str], columns: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(units), len(columns)), np.float32)
    for row, unit in enumerate(units):
        for code, weight in features(unit).items():
            if code in columns:
                out[row, columns[code]] = weight
    return out


@dataclass
class Model:
    """Weight of each subsequence, the threshold, and how decision values become probabilities."""

    table: np.ndarray
    bias: float
    slopes: tuple[float, float] = (1.0, 0.0)
    shift: float = 0.0

    def decide(self, texts: list[str]) -> np.ndarray:
        """The decision values of each text's worst and second worst unit; missing units count as empty ones."""
        values, _, owner = unit_values(self.table, texts)
        values = np.maximum(np.concatenate((values, np.zeros(2 * len(texts), values.dtype))), 0)
        owner = np.concatenate((owner, np.tile(np.arange(len(texts)), 2)))
        order = np.lexsort((values, owner))
        ends = np.searchsorted(owner[order], np.arange(len(texts)), "right")
        return np.stack((values[order[ends - 1]], values[order[ends - 2]]), axis=1).astype(np.float64) + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.decide(texts) @ np.array(self.slopes) + self.shift)))

    def worst_unit(self, text: str) -> str:
        values, first, _ = unit_values(self.table, [text])
        place = int(first[values.argmax()])
        return unit_at(text, place)


def unit_at(text: str, place: int) -> str:
    """The unit whose edge is at `place` of the encoded text, which begins with an edge of its own."""
    found, kept, _ = encode([text])
    edges = kept[found == EDGE]
    after = edges[edges > place]
    return text[place : int(after[0]) - 1] if len(after) else ""


def fit_machine(rows: np.ndarray, sign: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss: Newton steps over the rows inside the margin."""
    data = np.hstack((rows, np.ones((len(rows), 1), rows.dtype))).astype(np.float64)
    keep = np.full(data.shape[1], PENALTY * weight.sum())
    keep[-1] *= 1e-3
    found = np.zeros(data.shape[1])
    for _ in range(30):
        active = sign * (data @ found) < 1
        part = data[active] * weight[active, None]
        new = np.linalg.solve(np.diag(keep) + part.T @ data[active], part.T @ sign[active])
        if np.allclose(new, found, atol=1e-8):
            break
        found = new
    return found[:-1], float(found[-1])


def fit_sigmoid(values: np.ndarray, labels: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes (not negative) and shift of the probability of label 1, with smoothed targets, by Newton steps."""
    positive = max(1.0, float(labels.sum()))
    negative = max(1.0, float((1 - labels).sum()))
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    data = np.hstack((values, np.ones((len(values), 1))))
    found = np.array([1.0, 1.0, math.log(positive / negative)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ found, -30, 30)))
        slope = data.T @ (p - target) + 1e-3 * found
        curve = (data * (p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(3)
        found = found - np.clip(np.linalg.solve(curve, slope), -5, 5)
    return (max(float(found[0]), 1e-3), max(float(found[1]), 0.0)), float(found[2])


def train(samples: list[tuple[str, int]]) -> Model | None:
    """A model from (text, label) pairs; None unless both labels occur."""
    samples = sorted({(t, int(label)) for t, label in samples})
    fit = [s for s in samples if zlib.crc32(s[0].encode()) % 4]
    check = [s for s in samples if zlib.crc32(s[0].encode()) % 4 == 0]
    if len({label for _, label in fit}) < 2:
        fit = check = samples
    if len({label for _, label in fit}) < 2:
        return None
    if len({label for _, label in check}) < 2:
        check = fit
    toxic, clean = [t for t, label in fit if label], [t for t, label in fit if not label]

    words = lambda text: set(WORD.findall(text.lower()))
    in_toxic, in_clean = Counter(w for t in toxic for w in words(t)), Counter(w for t in clean for w in words(t))
    odds = {w: (n / len(toxic)) / ((in_clean[w] + 0.5) / len(clean)) for w, n in in_toxic.items() if n >= min(3, len(toxic))}
    telling = sorted(odds, key=lambda w: (-odds[w] * math.sqrt(in_toxic[w]), w))[: LANDMARKS // 2]
    common = sorted(in_clean, key=lambda w: (-in_clean[w], w))[:2000]
    mixed = sorted(common, key=lambda w: zlib.crc32(w.encode()))
    # Units and the number of documents each speaks for; harmless common words count once.
    positive = Counter({w: in_toxic[w] for w in telling if odds[w] >= 5} or {w: in_toxic[w] for w in telling[:4]})
    negative = Counter({w: 1 for w in mixed if w not in positive})
    landmarks = sorted(set(telling) | set(mixed[: LANDMARKS - len(telling)]))
    model = None
    for number in range(ROUNDS + 1):
        columns = {code: k for k, code in enumerate(sorted({c for w in landmarks for c in features(w)}))}
        own = matrix(landmarks, columns)
        roots, axes = np.linalg.eigh((own @ own.T).astype(np.float64) + 1e-6 * np.eye(len(landmarks)))
        half = axes / np.sqrt(np.maximum(roots, 1e-6)) @ axes.T
        units = [*sorted(positive), *sorted(negative)]
        sign = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        weight = np.array([positive[u] for u in sorted(positive)] + [negative[u] for u in sorted(negative)], np.float64)
        machine, bias = fit_machine(matrix(units, columns) @ own.T @ half, sign, weight)
        table = np.zeros(CLASSES**3, np.float32)
        table[list(columns)] = own.T @ (half @ machine)
        model = Model(table, bias)
        if number == ROUNDS:
            break
        # Witnesses of toxic documents, without the weakest twentieth (labels err), and the worst units of clean ones.
        witness, worst = worst_units(model, toxic), worst_units(model, clean)
        floor = np.quantile([v for _, v in witness], 0.05) if witness else 0
        positive = Counter(u for u, v in witness if v >= floor) or positive
        for unit, _ in worst:
            negative[unit] += 1
        landmarks = sorted(
            {u for u, _ in positive.most_common(LANDMARKS // 2)}
            | {u for u, _ in Counter(u for u, _ in worst).most_common(LANDMARKS // 4)}
            | set(mixed[: LANDMARKS // 4])
        )
    values = np.concatenate([model.decide([t for t, _ in check[k : k + 256]]) for k in range(0, len(check), 256)])
    model.slopes, model.shift = fit_sigmoid(values, np.array([label for _, label in check], np.float64))
    return model


def worst_units(model: Model, texts: list[str]) -> list[tuple[str, float]]:
    """(unit in lower case, value) of the worst unit of each text that has one."""
    out = []
    for at in range(0, len(texts), 128):
        part = texts[at : at + 128]
        values, first, owner = unit_values(model.table, part)
        best = {}
        for k in np.argsort(values, kind="stable"):
            best[owner[k]] = k
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        for text, k in best.items():
            unit = unit_at(part[text], int(first[k] - starts[text])).lower()
            if unit:
                out.append((unit, float(values[k])))
    return out


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose label is not learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (MAX_TOXIC, MAX_CLEAN)) -> Model | None:
    """A model from about `most` (toxic, clean) labelled rows that are not held out and have 1 to MAX_CHARS characters.

    Documents with several labels count as toxic if one says so. The sample of labels is bounded, so it is broadcast.
    """
    known = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [bounded_sample(known.filter(F.col("toxic") == label), "doc_id", n) for label, n in ((1, most[0]), (0, most[1]))]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, MAX_CHARS))
    return train([(row.text, row.toxic) for row in rows.join(F.broadcast(chosen), "doc_id").collect()])


def toxicity(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1, higher: more likely toxic) and `predicted` (1 from 0.5 on), from the text alone.

    Null and empty texts score as a text without units. Without a model (no labels of both kinds) every score is 0.
    Rows are scored one by one, equal texts alike. Taken column names get underscores. No shuffle.
    """

    def judge(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.0] * len(text), pa.float64())
        parts: list[np.ndarray] = [np.zeros(0)]
        held: list[str] = []
        chars = 0
        for value in text:
            one = value.as_py() or ""
            if held and chars + len(one) > 400_000:
                parts.append(model.score(held))
                held, chars = [], 0
            held.append(one)
            chars += len(one)
        if held:
            parts.append(model.score(held))
        return pa.array(np.concatenate(parts), pa.float64())

    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    rows = docs.withColumn(score, F.arrow_udf(judge, "double")(F.col(text_column).cast("string")))
    return rows.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
