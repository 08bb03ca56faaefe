"""The batch views.

All but the timeline and the history take the rollup (`operators.rollup.rollup`) of the alerts. A view is unsorted
unless it is a top list; `ordered` gives the reading order. Every order ends in the group key, so that equal scores
come in a fixed order.

`-`, the placeholder target of the two derived alerts, counts as a target in ip_reputation, global_attack_patterns,
ip_attack_types and threat_timeline, and is left out of target_ip_stats, attacker_victim_stats and the KPI.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions.classify import indicator_conditions
from netsentry.functions.score import risk_level, weighted_score
from netsentry.functions.text import row_key
from netsentry.operators import enrich
from netsentry.operators.rollup import indicator_totals
from netsentry.operators.topk import newest
from netsentry.rules import (
    HIGH_RISK_SCORE,
    HISTORY_LIMIT,
    IP_WEIGHTS,
    NO_VALUE,
    PAIR_WEIGHTS,
    TARGET_WEIGHTS,
    TOP_N,
)

LABELS = ("malicious", "suspicious")
ATTACKS = (
    "sqli", "xss", "scan", "bruteforce", "exfiltration", "file_attack", "admin_probe", "sensitive_file",
    "command_injection",
)
ALL_INDICATORS = (*LABELS, "blocked", *ATTACKS)
UNBLOCKED_INDICATORS = (*LABELS, *ATTACKS)
TARGET_INDICATORS = tuple(name for name in UNBLOCKED_INDICATORS if name != "bruteforce")

# Reading order of each view: descending columns, then ascending ones.
VIEW_ORDER = {
    "ip_reputation": (("risk_score", "total_alerts"), ("src_ip",)),
    "global_ip_stats": (("alert_count",), ("src_ip",)),
    "global_protocol_stats": (("alert_count",), ("protocol",)),
    "global_attack_patterns": (("alert_count",), ("alert_type",)),
    "ip_attack_types": (("alert_count",), ("src_ip", "alert_type")),
    "target_ip_stats": (("target_risk_score", "alert_count"), ("dest_ip",)),
    "threat_timeline": ((), ("time_bucket",)),
    "ip_historical_alerts": (("archived_at", "event_time"), ("row_hash",)),
    "attacker_victim_stats": (("relation_risk_score", "alert_count"), ("src_ip", "dest_ip")),
    "high_risk_ips": (("risk_score",), ("src_ip",)),
}

# Columns that form the row key of each view.
VIEW_KEYS = {
    "ip_reputation": ("src_ip",),
    "global_ip_stats": ("src_ip",),
    "global_protocol_stats": ("protocol",),
    "global_attack_patterns": ("alert_type",),
    "ip_attack_types": ("src_ip", "alert_type"),
    "target_ip_stats": ("dest_ip",),
    "threat_timeline": ("time_bucket",),
    "ip_historical_alerts": ("src_ip", "archived_at", "event_time", "row_hash"),
    "attacker_victim_stats": ("src_ip", "dest_ip"),
    "high_risk_ips": ("src_ip",),
}


def view_order(name: str) -> list[Column]:
    descending, ascending = VIEW_ORDER[name]
    return [F.col(c).desc() for c in descending] + [F.col(c).asc() for c in ascending]


def ordered(name: str, view: DataFrame, limit: int | None = None) -> DataFrame:
    """A view in its reading order, or the first `limit` rows of it."""
    rows = view.orderBy(*view_order(name))
    return rows if limit is None else rows.limit(limit)


def with_row_key(name: str, view: DataFrame) -> DataFrame:
    """Adds `row_key`. Rows of equal key replace each other: only history rows can share one (identical alerts with
    different byte counts), and the one with most bytes stays."""
    keyed = view.withColumn("row_key", row_key(*VIEW_KEYS[name]))
    if name != "ip_historical_alerts":
        return keyed
    others = [c for c in keyed.columns if c != "bytes_transferred"]
    return keyed.groupBy(*others).agg(F.max("bytes_transferred").alias("bytes_transferred")).select(*keyed.columns)


def _alert_total(name: str) -> Column:
    return F.sum("alerts").alias(name)


def _bytes_total() -> Column:
    return F.sum("bytes").alias("total_bytes")


def _distinct(column: str, name: str) -> Column:
    return F.count_distinct(column).alias(name)


def _last_times() -> list[Column]:
    return [F.max("last_event").alias("last_seen"), F.max("last_archived").alias("last_archived_at")]


def _with_target(df: DataFrame) -> DataFrame:
    # Three-valued logic: a null target is left out as well.
    return df.filter(F.col("dest_ip") != NO_VALUE)


def ip_reputation(rolled: DataFrame) -> DataFrame:
    stats = rolled.groupBy("src_ip").agg(
        _alert_total("total_alerts"),
        *indicator_totals(ALL_INDICATORS),
        _bytes_total(),
        _distinct("dest_ip", "unique_targets"),
        _distinct("protocol", "unique_protocols"),
        F.min("first_event").alias("first_seen"),
        F.max("last_event").alias("last_seen"),
        F.min("first_archived").alias("first_archived_at"),
        F.max("last_archived").alias("last_archived_at"),
    )
    scored = stats.withColumn("risk_score", weighted_score(IP_WEIGHTS))
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def global_ip_stats(rolled: DataFrame, limit: int | None = TOP_N) -> DataFrame:
    stats = rolled.groupBy("src_ip").agg(_alert_total("alert_count"), *indicator_totals(UNBLOCKED_INDICATORS))
    return stats if limit is None else ordered("global_ip_stats", stats, limit)


def global_protocol_stats(rolled: DataFrame) -> DataFrame:
    stats = rolled.groupBy("protocol").agg(
        _alert_total("alert_count"), *indicator_totals(ALL_INDICATORS), _bytes_total()
    )
    return stats.withColumn("avg_bytes_per_alert", F.round(F.col("total_bytes") / F.col("alert_count"), 2))


def global_attack_patterns(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("alert_type", "attack_category").agg(
        _alert_total("alert_count"),
        _distinct("src_ip", "unique_attackers"),
        _distinct("dest_ip", "unique_targets"),
        _bytes_total(),
        *_last_times(),
    )


def ip_attack_types(rolled: DataFrame) -> DataFrame:
    return rolled.groupBy("src_ip", "alert_type", "attack_category").agg(
        _alert_total("alert_count"),
        _distinct("dest_ip", "unique_targets"),
        _distinct("protocol", "unique_protocols"),
        _bytes_total(),
        *_last_times(),
    )


def target_ip_stats(rolled: DataFrame, limit: int | None = TOP_N) -> DataFrame:
    stats = _with_target(rolled).groupBy("dest_ip").agg(
        _alert_total("alert_count"),
        _distinct("src_ip", "unique_attackers"),
        _distinct("protocol", "unique_protocols"),
        *indicator_totals(TARGET_INDICATORS),
        _bytes_total(),
        *_last_times(),
    )
    scored = stats.withColumn("target_risk_score", weighted_score(TARGET_WEIGHTS))
    return scored if limit is None else ordered("target_ip_stats", scored, limit)


def attacker_victim_stats(rolled: DataFrame, limit: int | None = TOP_N) -> DataFrame:
    stats = _with_target(rolled).groupBy("src_ip", "dest_ip").agg(
        _alert_total("alert_count"),
        _distinct("protocol", "unique_protocols"),
        *indicator_totals(TARGET_INDICATORS),
        _bytes_total(),
        *_last_times(),
    )
    scored = stats.withColumn("relation_risk_score", weighted_score(PAIR_WEIGHTS))
    return scored if limit is None else ordered("attacker_victim_stats", scored, limit)


def high_risk_ips(reputation: DataFrame, limit: int | None = TOP_N) -> DataFrame:
    risky = reputation.filter(F.col("risk_score") >= HIGH_RISK_SCORE)
    return risky if limit is None else ordered("high_risk_ips", risky, limit)


def threat_timeline(alerts: DataFrame, time_col: str = "archived_at") -> DataFrame:
    """Alerts per minute of `time_col`."""
    marked = enrich.categorize(alerts)
    conditions = indicator_conditions(F.col("attack_category"), F.col("threat_label"), F.col("action"))
    minutes = (
        marked.groupBy(F.date_trunc("minute", time_col).alias("minute"))
        .agg(
            F.count("*").alias("total_alerts"),
            *[F.count_if(conditions[name]).alias(f"{name}_count") for name in UNBLOCKED_INDICATORS],
            _distinct("src_ip", "unique_attackers"),
            _distinct("dest_ip", "unique_targets"),
            F.min("event_time").alias("first_event_time"),
            F.max("event_time").alias("last_event_time"),
            F.min("archived_at").alias("first_archived_at"),
            F.max("archived_at").alias("last_archived_at"),
        )
    )
    # The bucket text is made after grouping: a timestamp is the cheaper key.
    return minutes.select(F.date_format("minute", "yyyy-MM-dd HH:mm:00").alias("time_bucket"), *minutes.columns[1:])


def ip_historical_alerts(alerts: DataFrame, limit: int | None = HISTORY_LIMIT) -> DataFrame:
    """Single alerts with their hash, the newest `limit` of them. With a limit the alerts are read twice."""
    detail = enrich.with_row_hash(enrich.categorize(alerts)).select(
        "row_hash",
        "src_ip",
        "dest_ip",
        "protocol",
        "path",
        "alert_type",
        "attack_category",
        "event_time",
        "archived_at",
        "bytes_transferred",
    )
    if limit is None:
        return detail
    return newest(detail, limit, ("archived_at", "event_time"), ("row_hash", "bytes_transferred"))


def total_unique_targets(alerts: DataFrame) -> DataFrame:
    """One row: distinct real targets over all alerts. Takes alerts or their rollup."""
    return _with_target(alerts).agg(_distinct("dest_ip", "total_unique_targets"))


def row_counts(**tables: DataFrame) -> DataFrame:
    """One row per named table: its number of rows."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


def all_views(alerts: DataFrame, rolled: DataFrame) -> dict[str, DataFrame]:
    """The ten stored views by name, in full: a reader that wants a top list gives its length. Both inputs are used many
    times: give stored tables."""
    reputation = ip_reputation(rolled)
    return {
        "ip_reputation": reputation,
        "global_ip_stats": global_ip_stats(rolled, limit=None),
        "global_protocol_stats": global_protocol_stats(rolled),
        "global_attack_patterns": global_attack_patterns(rolled),
        "ip_attack_types": ip_attack_types(rolled),
        "target_ip_stats": target_ip_stats(rolled, limit=None),
        "threat_timeline": threat_timeline(alerts),
        "ip_historical_alerts": ip_historical_alerts(alerts, limit=None),
        "attacker_victim_stats": attacker_victim_stats(rolled, limit=None),
        "high_risk_ips": high_risk_ips(reputation, limit=None),
    }
