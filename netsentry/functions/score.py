"""Scores, bands, recommendations and the display texts built from attack counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netsentry.rules import (
    ATTACK_LABELS,
    LOWEST_RELATION,
    LOWEST_RISK,
    NO_VALUE,
    RECOMMENDATIONS,
    RELATION_BANDS,
    RISK_BANDS,
    SCORE_CAP,
)


def weighted_score(weights: Mapping[str, int], cap: int = SCORE_CAP) -> Column:
    """Weighted sum of the named count columns, capped."""
    total = reduce(Column.__add__, [F.col(name) * F.lit(weight) for name, weight in weights.items()])
    return F.least(F.lit(cap).cast("long"), total)


def band(score: Column, bands: Sequence[tuple[int, str]], lowest: str) -> Column:
    chain = F
    for bound, name in bands:
        chain = chain.when(score >= bound, name)
    return chain.otherwise(lowest)


def risk_level(score: Column) -> Column:
    return band(score, RISK_BANDS, LOWEST_RISK)


def relation_level(score: Column) -> Column:
    return band(score, RELATION_BANDS, LOWEST_RELATION)


def recommendation(score: Column, live_total: Column, live_sqli: Column, live_scan: Column) -> Column:
    """Recommended level of an IP; nulls count as 0."""
    score, live_total, live_sqli, live_scan = (
        F.coalesce(c, F.lit(0)) for c in (score, live_total, live_sqli, live_scan)
    )
    return (
        F.when((score >= 80) | (live_total >= 10) | (live_sqli >= 5), "CRITICAL")
        .when((score >= 60) | (live_total >= 5) | (live_scan >= 4), "HIGH")
        .when((score >= 30) | (live_total > 0), "MEDIUM")
        .otherwise("LOW")
    )


def _by_level(level: Column, position: int) -> Column:
    chain = F
    for name, texts in RECOMMENDATIONS.items():
        chain = chain.when(level == name, texts[position])
    return chain


def recommended_action(level: Column) -> Column:
    return _by_level(level, 0)


def recommendation_reason(level: Column) -> Column:
    return _by_level(level, 1)


def dominant_attack(labels: Sequence[tuple[str, str]] = ATTACK_LABELS) -> Column:
    """`name (count)` of the largest count, the first in label order on ties, `-` if all are zero."""
    best = F.array_max(
        F.array(
            *[
                F.struct(
                    F.coalesce(F.col(column), F.lit(0)).alias("n"),
                    F.lit(-position).alias("order"),
                    F.lit(name).alias("name"),
                )
                for position, (name, column) in enumerate(labels)
            ]
        )
    )
    return F.when(best["n"] > 0, F.format_string("%s (%d)", best["name"], best["n"])).otherwise(NO_VALUE)


def attack_counts_text(labels: Sequence[tuple[str, str]] = ATTACK_LABELS) -> Column:
    """Non-zero counts as `name=count | name=count`, `-` if there is none."""
    parts = [
        F.when(F.col(column) > 0, F.concat(F.lit(f"{name}="), F.col(column).cast("string")))
        for name, column in labels
    ]
    text = F.concat_ws(" | ", *parts)
    return F.when(text == "", NO_VALUE).otherwise(text)
