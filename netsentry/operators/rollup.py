"""The shared pre-aggregation behind the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions.classify import attack_category
from netsentry.rules import CATEGORY_INDICATORS

ROLLUP_KEYS = ("src_ip", "dest_ip", "protocol", "alert_type")


def rollup(alerts: DataFrame) -> DataFrame:
    """Alerts summed per source, target, protocol and type, with every partial measure the views need.

    The views sum and take minima and maxima of these rows, and count distinct values over them, which is exact.
    Spark evaluates several distinct counts by copying its input once per count; doing that to this table instead
    of to the alerts is what makes the views cheap. The full key spreads a hot source over its targets,
    protocols and alert types.
    """
    sums = alerts.groupBy(*ROLLUP_KEYS).agg(
        F.count("*").alias("alerts"),
        F.count_if(F.col("threat_label") == "malicious").alias("malicious"),
        F.count_if(F.col("threat_label") == "suspicious").alias("suspicious"),
        F.count_if(F.col("action") == "blocked").alias("blocked"),
        F.sum("bytes_transferred").alias("bytes"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
        F.min("archived_at").alias("first_archived"),
        F.max("archived_at").alias("last_archived"),
    )
    return sums.withColumn("attack_category", attack_category(F.col("alert_type")))


def merged_rollup(parts: DataFrame) -> DataFrame:
    """Rollups of several parts of the alerts as the rollup of all of them: every measure is a sum, minimum or maximum."""
    sums = [F.sum(c).alias(c) for c in ("alerts", "malicious", "suspicious", "blocked", "bytes")]
    times = [(F.min if c.startswith("first") else F.max)(c).alias(c) for c in ("first_event", "last_event", "first_archived", "last_archived")]
    return parts.groupBy(*ROLLUP_KEYS, "attack_category").agg(*sums, *times).select(*[c for c in parts.columns if c != "part"])


def indicator_totals(names: tuple[str, ...]) -> list[Column]:
    """Indicator sums `<name>_count` over rollup rows."""
    totals = []
    for name in names:
        if name in CATEGORY_INDICATORS:
            marked = F.col("attack_category") == CATEGORY_INDICATORS[name]
            hits = F.when(marked, F.col("alerts")).otherwise(F.lit(0).cast("long"))
        else:
            hits = F.col(name)
        totals.append(F.sum(hits).alias(f"{name}_count"))
    return totals
