"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at the statistics of a document and votes good (1), bad (0) or abstains (null). No rule decides alone:
expectation-maximisation over the vote patterns of all documents estimates the share of good documents and each rule's
two accuracies, how often it votes good on good documents and bad on bad ones (junk mostly trips one rule of many, so the
second is far lower), and a document's posterior probability of being good decides. A pattern is one of 3^rules at most,
so the table of pattern counts is bounded however many documents there are; all rounds of EM are one expression over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.llm.common import SPACE, stored

WINDOW = 8  # words of a window that counts as repeated
MIN_WORDS, MAX_REPEATED = 20, 30  # fewer words, or a larger percentage of repeated ones, fail a document outright
ROUNDS = 30
#: Where EM starts (accuracy on good and on bad documents, share of good ones), and the bounds it keeps to.
START_GOOD, START_BAD, START_SHARE = 0.99, 0.3, 0.85
BOUNDS, BOUNDS_SHARE = (0.0001, 0.9999), (0.05, 0.98)
#: Imagined votes at the starting accuracies, as parts of all documents. Those on good documents say that any rule errs at
#: times: without them a rule that hardly ever errs gets an accuracy near 1, and one bad vote of it outweighs all others.
PRIOR_GOOD, PRIOR_BAD = 0.3, 0.001
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(self.bad, 0).when(self.good, 1).alias(self.name)


def rules() -> tuple[Rule, ...]:
    """Votes over the columns of `statistics`. Both limits leave room between them, where a rule abstains."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    mean = per_word("word_chars")
    return (
        Rule("symbols", per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        Rule("marks", per_word("n_marks") > 0.2, per_word("n_marks") < 0.02),
        Rule("repetition", per_word("n_repeat_words") > 0.3, per_word("n_repeat_words") < 0.05),
        Rule("stutter", per_word("n_stutters") > 0.2, per_word("n_stutters") < 0.05),
        Rule("lines", F.col("n_dup_lines") >= F.greatest(F.lit(2.0), 0.3 * F.col("n_lines")), F.col("n_dup_lines") <= 0.05 * F.col("n_lines")),
        Rule("word_length", (mean < 2.5) | (mean > 14), mean.between(3.5, 10)),
        Rule("letters", per_char("n_letters") < 0.65, per_char("n_letters") > 0.93),
        Rule("capitals", F.col("n_capitals") > 0.5 * F.col("n_letters"), F.col("n_capitals") < 0.2 * F.col("n_letters")),
        Rule("shouting", per_word("n_shouts") > 0.3, per_word("n_shouts") < 0.05),
        Rule("length", F.col("n_words") < MIN_WORDS, F.col("n_words") >= 2 * MIN_WORDS),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """`doc_id` and counts per row, from `doc_id` and `text` (null: no words).

    A window's words are compared by a 64-bit hash, within one document.
    """
    without = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    words = base.select(
        "doc_id", "text",
        F.length(F.regexp_replace("text", SPACE, "")).alias("word_chars"),
        F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), SPACE).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
    )
    n_words = F.when(F.col("word_chars") == 0, 0).otherwise(F.size("words"))
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    windows = words.select(
        "doc_id", "word_chars",
        n_words.cast("bigint").alias("n_words"),
        without(F.col("text"), SYMBOLS).alias("n_symbols"),
        without(F.col("text"), "!").alias("n_shouts"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[#*$%&|<>]+(?![^\x20\x09-\x0D])")).alias("n_marks"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).alias("n_letters"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_capitals"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("words", lambda word, k: word == F.get("words", k - 1))).alias("n_stutters"),
        F.transform(starts, lambda at: F.xxhash64(F.slice("words", at, F.lit(WINDOW)))).alias("windows"),
    )
    # Windows in order of their hash, with their places: equal ones are neighbours.
    placed = F.array_sort(F.transform("windows", lambda window, at: F.struct(window.alias("h"), at.alias("at"))))
    sorted_ = windows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    twice = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    places = sorted_.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["at"]))).drop("sorted")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last")),
        lambda sum_, at: F.struct((sum_["covered"] + F.least(F.lit(WINDOW), at - sum_["last"])).alias("covered"), at.alias("last")),
        lambda sum_: sum_["covered"],
    )
    counts = places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("places")
    return counts.select("doc_id", *(F.col(c).cast("bigint") for c in counts.columns if c != "doc_id"))


def posterior(votes: Column, model: Column) -> Column:
    """The probability of good given the array of votes; `model` has `share` and the arrays `on_good`, `on_bad`."""
    both = F.aggregate(
        F.arrays_zip(votes.alias("v"), model["on_good"].alias("g"), model["on_bad"].alias("b")),
        F.struct(model["share"].alias("yes"), (1 - model["share"]).alias("no")),
        lambda p, x: F.when(x["v"].isNull(), p)
        .when(x["v"] == 1, F.struct((p["yes"] * x["g"]).alias("yes"), (p["no"] * (1 - x["b"])).alias("no")))
        .otherwise(F.struct((p["yes"] * (1 - x["g"])).alias("yes"), (p["no"] * x["b"]).alias("no"))),
    )
    return F.transform(F.array(both), lambda p: p["yes"] / (p["yes"] + p["no"]))[0]


def estimate(votes: DataFrame, count: int) -> DataFrame:
    """One row with `model` (`share`, `on_good`, `on_bad`) after ROUNDS of EM, from an array column `votes`."""
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    held = lambda value, bounds: F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), value))
    add = lambda rows, of: F.aggregate(rows, F.lit(0.0), lambda total, x: total + of(x))

    def once(model: Column, _: Column) -> Column:
        weighed = F.transform("patterns", lambda p: F.struct(p["votes"].alias("v"), p["n"].cast("double").alias("n"), posterior(p["votes"], model).alias("q")))

        def accuracy(rows: Column, vote: int, start: float, prior: float) -> Column:
            share = lambda x: x["n"] * (x["q"] if vote else 1 - x["q"])
            # One imagined vote at least, so that a rule that never votes has an accuracy too.
            imagined = F.greatest(F.lit(1.0), prior * add(rows, lambda x: x["n"]))
            return F.transform(
                F.sequence(F.lit(0), F.lit(count - 1)),
                lambda r: held(
                    (add(rows, lambda x: F.when(x["v"][r] == vote, share(x)).otherwise(0.0)) + start * imagined)
                    / (add(rows, lambda x: F.when(x["v"][r].isNotNull(), share(x)).otherwise(0.0)) + imagined),
                    BOUNDS,
                ),
            )

        return F.transform(
            F.array(weighed),
            lambda rows: F.struct(
                held((add(rows, lambda x: x["n"] * x["q"]) + START_SHARE) / (add(rows, lambda x: x["n"]) + 1), BOUNDS_SHARE).alias("share"),
                accuracy(rows, 1, START_GOOD, PRIOR_GOOD).alias("on_good"),
                accuracy(rows, 0, START_BAD, PRIOR_BAD).alias("on_bad"),
            ),
        )[0]

    repeat = lambda value: F.array_repeat(F.lit(value), count)
    start = F.struct(F.lit(START_SHARE).alias("share"), repeat(START_GOOD).alias("on_good"), repeat(START_BAD).alias("on_bad"))
    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, once).alias("model"))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: `doc_id`, the statistics, `base_failed`, the votes, `quality` (posterior) and `kept`.

    Null texts count as empty: no words, so `base_failed`. Rows are judged one by one, equal rows alike; ids may repeat or
    be null; other columns are not read. An empty table gives no rows. The statistics are stored once, without texts.
    """
    stats = stored(statistics(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))), "quality-statistics")
    names = [rule.name for rule in rules()]
    voted = stats.select("*", *(rule.vote() for rule in rules())).withColumn("votes", F.array(*names))
    # One row of 2 * rules + 1 numbers, which the driver hands on as constants.
    found = estimate(voted.select("votes"), len(names)).first()["model"]
    numbers = lambda values: F.array(*(F.lit(v) for v in values))
    model = F.struct(F.lit(found["share"]).alias("share"), numbers(found["on_good"]).alias("on_good"), numbers(found["on_bad"]).alias("on_bad"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("quality", posterior(F.col("votes"), model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .drop("votes")
    )
