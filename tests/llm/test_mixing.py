import struct
from collections import defaultdict
from math import ceil

import pytest
import xxhash
from pyspark.sql import functions as F

from netsentry.llm.mixing import cut_text, mix_counts, mix_documents, sainte_lague, targets


def brute_targets(sizes, weights, share, cap):
    """Targets by giving the excess back until none is above its cap."""
    goal, capped = share * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        left = goal - sum(capped.values())
        want = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: cap * sizes[s] for s in rest if want[s] > cap * sizes[s]}
        if not over:
            return capped | want
        capped |= over
        if len(capped) == len(sizes):
            return capped


@pytest.mark.parametrize("sizes", [[10, 20, 30], [1000, 1, 1], [5, 5, 5, 5000, 0], [7]])
def test_targets(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes))]
    weights = {n: float([5, 2, 1][k % 3]) for k, n in enumerate(names)}
    rows = spark.createDataFrame([(n, s, weights[n]) for n, s in zip(names, sizes)], "source string, tokens bigint, weight double")
    found = {r.source: r.target for r in targets(rows, 1.5, 2.0).collect()}
    assert found == pytest.approx(brute_targets(dict(zip(names, sizes)), weights, 1.5, 2.0))


@pytest.mark.parametrize("seats", [0, 1, 2, 7, 100, 1001])
def test_sainte_lague_is_by_highest_quotients(spark, seats):
    weights = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 1.0, "e": 0.0}
    most = {"a": 40, "b": 1000, "c": 1000, "d": 1000, "e": 1000}
    rows = spark.createDataFrame([("g", n, w, most[n]) for n, w in weights.items()], "g string, name string, w double, most bigint")
    found = {r.name: r.seats for r in sainte_lague(rows, ["g"], "w", F.lit(seats), F.col("most"), ["name"]).collect()}
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [n for n in weights if weights[n] > 0 and got[n] < 10**6]
        best = max(open_, key=lambda n: (weights[n] / (2 * got[n] + 1), [-ord(n)]))
        got[best] += 1
    if got["a"] <= most["a"]:
        assert found == got
    else:  # at its cap; the others lie within a block of their share of the seats that are left to rank
        assert found["a"] == most["a"]


def test_mix_is_near_its_targets_and_the_same_again(spark):
    docs = spark.range(900).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 4) END AS source",
        "repeat('word ', CAST(20 + id % 150 AS INT)) AS text",
    )
    rows = mix_counts(docs).collect()
    assert len(rows) == 900
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.target, r.source_size].append(r)
    for (target, size), own in by.items():
        assert sum(r.size for r in own) == size and target <= 2 * size
        assert abs(sum(r.taken for r in own) - target) <= 100
    assert sum(target for target, _ in by) == pytest.approx(1.5 * sum(r.size for r in rows))
    again = mix_counts(docs.repartition(5)).collect()
    assert sorted(again) == sorted(rows)


def hashed(*values):
    """Spark's xxhash64 of these values, whole numbers being bigint unless they are the first."""
    seed = 42
    for place, value in enumerate(values):
        if value is not None:
            raw = value.encode() if isinstance(value, str) else struct.pack("<q" if place else "<i", value)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) * (seed >> 63)


def brute_seats(weights, seats, most):
    """Seats one by one to the highest quotient, the first of equal ones."""
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max((n for n in weights if got[n] < most[n]), key=lambda n: weights[n] / (2 * got[n] + 1))
        got[best] += 1
    return got


def brute_taken(docs, shard_tokens, seed=42, block=64):
    """doc_id: words taken, with lists and loops. `docs` are (doc_id, source, size)."""
    names = sorted({d[1] for d in docs}, key=lambda n: (n is None, n or ""))
    sizes = {n: sum(d[2] for d in docs if d[1] == n) for n in names}
    goal = brute_targets(sizes, {n: float([5, 2, 1][k % 3]) for k, n in enumerate(names)}, 1.5, 2.0)
    lines = defaultdict(list)
    for doc, source, size in docs:
        if size:
            key = xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
            key = xxhash.xxh64_intdigest(source.encode(), key) if source is not None else key
            key = xxhash.xxh64_intdigest(struct.pack("<q", size), key)
            key -= (1 << 64) * (key >> 63)
            shard = hashed(seed, key) % max(1, ceil(sizes[source] / shard_tokens))
            lines[source, shard].append((hashed(seed + 1, key), key, doc, size))
    blocks = {at: ceil(sum(r[3] for r in line) / block) for at, line in lines.items()}
    of = {n: sum(b for (source, _), b in blocks.items() if source == n) for n in names}
    full = [n for n in names if goal[n] >= 2 * sizes[n]]
    wanted = {n: goal[n] * of[n] / sizes[n] for n in names if n not in full}
    quota = brute_seats(wanted, round(sum(wanted.values())), {n: 2 * of[n] for n in wanted}) | {n: 2 * of[n] for n in full}
    taken = dict.fromkeys((d[0] for d in docs), 0)
    for name in names:
        own = {at: blocks[at] for at in sorted(a for a in lines if a[0] == name)}
        for at, seats in brute_seats(own, quota[name], {a: 2 * b for a, b in own.items()}).items():
            order = sorted(range(blocks[at]), key=lambda b: (hashed(seed + 2, name, at[1], b), b))
            times = {b: seats // blocks[at] + (k < seats % blocks[at]) for k, b in enumerate(order)}
            word = 0
            for _, _, doc, size in sorted(lines[at]):
                taken[doc] += sum(times[w // block] for w in range(word, word + size))
                word += size
    return taken


@pytest.mark.parametrize("shard_tokens", [1_000_000, 2_000, 150])
def test_taken_equals_brute_force(spark, shard_tokens):
    names = ["hot", "hot", "hot", "b", "c", None, "d", "é"]
    docs = [(k, names[k % 8] if k % 11 else "hot", 0 if k % 37 == 0 else 3 + k * k % 190) for k in range(500)]
    rows = spark.createDataFrame(docs, "doc_id bigint, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    found = {r.doc_id: r.taken for r in mix_counts(rows.repartition(4), shard_tokens=shard_tokens).collect()}
    assert found == brute_taken(docs, shard_tokens)


def test_seats_of_a_large_group(spark):
    """A group of very many rows next to small ones and one without name; no window of the plan holds a group."""
    sizes = [("hot", k, 1 + k * 7919 % 50) for k in range(3000)] + [("b", 0, 9), (None, 0, 4), (None, 1, 4)]
    rows = spark.createDataFrame(sizes, "source string, shard bigint, blocks bigint")
    seats = F.when(F.col("source") == "hot", 100_001).when(F.col("source") == "b", 10).otherwise(5)
    found = sainte_lague(rows, ["source"], "blocks", seats, F.col("blocks") * 2, ["shard"])
    assert "row_number" not in found._jdf.queryExecution().toString()
    got = {(r.source, r.shard): r.seats for r in found.collect()}
    assert got["b", 0] == 10 and (got[None, 0], got[None, 1]) == (3, 2)
    hot = [(b, got["hot", k]) for n, k, b in sizes if n == "hot"]
    assert sum(s for _, s in hot) == 100_001
    # The last quotients that won are not below the first that lost.
    assert min(b / (2 * s - 1) for b, s in hot if s) >= max(b / (2 * s + 1) for b, s in hot)


def test_cut_text():
    text = " a b  c\td e "
    assert cut_text(text, [(0, 5, 1)], 1) == text
    assert cut_text(text, [(0, 2, 2), (2, 3, 1), (4, 5, 1)], 1) == "a b  c\ne"
    assert cut_text(text, [(0, 2, 2), (2, 3, 1), (4, 5, 1)], 2) == "a b"


def test_hostile_rows(hostile, nothing):
    rows = mix_counts(hostile).collect()
    assert len(rows) == hostile.count()
    words = lambda r: len((r.text or "").split())
    assert sorted(r.size for r in rows) == sorted(words(r) for r in hostile.collect())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    mixed = mix_documents(hostile)
    assert mixed.columns == hostile.columns
    assert sum(words(r) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    assert mix_counts(nothing).count() == 0 and mix_documents(nothing).count() == 0


def test_texts_are_cut_once(hostile):
    """The filter that comes with an explosion must not cut them before, in a Python worker more for each task."""
    assert mix_documents(hostile)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
