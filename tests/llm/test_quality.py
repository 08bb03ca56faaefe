import random
import re
from collections import Counter

from pyspark.sql import functions as F

from netsentry.llm import quality as Q
from netsentry.llm.quality import estimate, posterior, quality, statistics


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated_lines, len(covered)


def test_statistics(spark, hostile):
    rng = random.Random(9)
    pieces = ["a", "b", "c d e f g h i j k ", " ", "\n", "\x0b", "#", "é😀", "line of words\n", "$$", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["a b c d e f g h", "a " * 9, "a " * 8, "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8", *(r.text for r in hostile.collect())]
    rows = statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute(texts[row.doc_id])


def test_em_equals_plain_numbers(spark):
    rng = random.Random(3)
    votes = []
    for _ in range(400):
        good = rng.random() < 0.8
        votes.append([None if rng.random() < 0.2 else int(rng.random() < (0.97 if good else 0.6)) for _ in range(4)])
    frame = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    model = estimate(frame, 4).first().model

    share, on_good, on_bad, _ = plain_em(votes)
    assert abs(model.share - share) < 1e-9
    assert all(abs(a - b) < 1e-9 for a, b in zip([*model.on_good, *model.on_bad], [*on_good, *on_bad]))


def plain_em(votes):
    held = lambda x, bounds: min(max(x, bounds[0]), bounds[1])
    rules = range(len(votes[0]))
    share, on_good, on_bad = Q.START_SHARE, [Q.START_GOOD for _ in rules], [Q.START_BAD for _ in rules]
    imagined = [max(1.0, prior * len(votes)) for prior in (Q.PRIOR_GOOD, Q.PRIOR_BAD)]

    def posteriors():
        for v in votes:
            yes, no = share, 1 - share
            for k, x in enumerate(v):
                if x is not None:
                    yes, no = yes * (on_good[k] if x else 1 - on_good[k]), no * (1 - on_bad[k] if x else on_bad[k])
            yield yes / (yes + no)

    for _ in range(Q.ROUNDS):
        post = list(posteriors())
        share = held((sum(post) + Q.START_SHARE) / (len(votes) + 1), Q.BOUNDS_SHARE)
        pairs = [[(v[k], p) for v, p in zip(votes, post) if v[k] is not None] for k in rules]
        on_good = [held((sum(p for x, p in r if x) + Q.START_GOOD * imagined[0]) / (sum(p for _, p in r) + imagined[0]), Q.BOUNDS) for r in pairs]
        on_bad = [held((sum(1 - p for x, p in r if not x) + Q.START_BAD * imagined[1]) / (sum(1 - p for _, p in r) + imagined[1]), Q.BOUNDS) for r in pairs]
    return share, on_good, on_bad, list(posteriors())


def plain_votes(r):
    """The rules over a row of statistics, in plain Python."""
    words, chars = max(r.n_words, 1), max(r.word_chars, 1)
    mean = r.word_chars / words
    limits = [
        (r.n_symbols / words > 0.1, r.n_symbols / words < 0.02),
        (r.n_marks / words > 0.2, r.n_marks / words < 0.02),
        (r.n_repeat_words / words > 0.3, r.n_repeat_words / words < 0.05),
        (r.n_stutters / words > 0.2, r.n_stutters / words < 0.05),
        (r.n_dup_lines >= max(2.0, 0.3 * r.n_lines), r.n_dup_lines <= 0.05 * r.n_lines),
        (mean < 2.5 or mean > 14, 3.5 <= mean <= 10),
        (r.n_letters / chars < 0.65, r.n_letters / chars > 0.93),
        (r.n_capitals > 0.5 * r.n_letters, r.n_capitals < 0.2 * r.n_letters),
        (r.n_shouts / words > 0.3, r.n_shouts / words < 0.05),
        (r.n_words < 20, r.n_words >= 40),
    ]
    return [0 if bad else 1 if good else None for bad, good in limits]


def test_kept_equals_plain_python(spark):
    rows = quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    post = plain_em([plain_votes(r) for r in rows])[3]
    for row, p in zip(rows, post):
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert abs(row.quality - p) < 1e-6 and row.base_failed == failed
        assert row.kept == (not failed and p >= 0.5) or abs(p - 0.5) < 1e-6


def test_em_finds_the_accuracies_and_decides_otherwise_than_all_must_pass(spark):
    rng = random.Random(8)
    good_at, bad_at = [0.99, 0.96, 0.93, 0.97, 0.9, 0.98], [0.9, 0.7, 0.5, 0.8, 0.3, 0.6]
    votes, truth = [], []
    for _ in range(20_000):
        truth.append(rng.random() < 0.8)
        votes.append([None if rng.random() < 0.1 else int(rng.random() < (g if truth[-1] else 1 - b)) for g, b in zip(good_at, bad_at)])
    model = estimate(spark.createDataFrame([(v,) for v in votes], "votes array<int>"), 6).first().model
    assert all(abs(a - b) < 0.03 for a, b in zip([*model.on_good, *model.on_bad], good_at + bad_at)) and abs(model.share - 0.8) < 0.03
    kept = [p >= 0.5 for p in plain_em(votes)[3]]
    right = lambda verdicts: sum(v == t for v, t in zip(verdicts, truth)) / len(truth)
    assert right(kept) > right([0 not in v for v in votes]) + 0.05


def test_the_posterior_decides(spark):
    rows = quality(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("NOT base_failed").collect()
    names = [rule.name for rule in Q.rules()]
    bad = Counter((sum(r[n] == 0 for n in names), r.kept) for r in rows)
    assert bad[1, True] and bad[1, False] and bad[2, False]  # one bad vote of a weak rule is outweighed, two are not


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality(docs)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_good_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    counts = Counter((r.label, r.base_failed, r.kept) for r in rows.join(labels, "doc_id").collect())
    good, junk = counts[1, False, True], counts[0, False, False] + counts[0, True, False]
    assert good >= 0.99 * (good + counts[1, False, False])
    assert junk >= 0.9 * (junk + counts[0, False, True])


def test_hostile_rows(hostile, nothing):
    rows = quality(hostile).collect()
    assert len(rows) == hostile.count()
    for row in rows:
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert row.base_failed == failed and 0 <= row.quality <= 1 and not (failed and row.kept)
    assert quality(nothing).count() == 0


def test_posterior_abstains(spark):
    model = F.struct(F.lit(0.5).alias("share"), F.array(F.lit(0.9)).alias("on_good"), F.array(F.lit(0.7)).alias("on_bad"))
    frame = spark.createDataFrame([([None],), ([1],), ([0],)], "votes array<int>")
    found = [r[0] for r in frame.select(posterior(F.col("votes"), model)).collect()]
    assert [round(p, 6) for p in found] == [0.5, round(0.9 / 1.2, 6), round(0.1 / 0.8, 6)]
