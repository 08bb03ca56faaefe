"""Serving reads over the live table and the batch views.

Where the question is about one IP, the functions here answer it for all IPs in one frame, or for one IP if they are given
it as `ip`: their inputs are then filtered first, before any join or ranking, so that the filter reaches stored tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsentry.functions.classify import live_family_conditions
from netsentry.functions.score import recommendation, recommendation_reason, recommended_action, risk_level
from netsentry.functions.text import number_or_zero, whole_or_zero
from netsentry.operators.topk import newest, top_per_key
from netsentry.plans.views import (
    ATTACKS,
    LABELS,
    high_risk_ips,
    row_counts,
    total_unique_targets,
    view_order,
    with_row_key,
)
from netsentry.rules import FEED_DEFAULT, FEED_LIMITS, NO_VALUE, RISK_LEVELS, SIGNALS

# List lengths.
LIVE_PER_IP = 200
SUMMARY_ALERTS = 100
RELATIONS_PER_IP = 30
TYPES_PER_IP = 50
HISTORY_PER_IP = 200
TIMELINE_POINTS = 24
ANALYTICS_LISTS = {
    "ip_reputation": ("risk_score", 100),
    "high_risk_ips": ("risk_score", 100),
    "target_ip_stats": ("target_risk_score", 100),
    "attacker_victim_stats": ("relation_risk_score", 100),
    "global_protocol_stats": ("alert_count", 50),
    "global_attack_patterns": ("alert_count", 80),
}
BUNDLE_LISTS = {
    "global_ip_stats": ("alert_count", 100),
    "global_protocol_stats": ("alert_count", 100),
    "global_attack_patterns": ("alert_count", 100),
}


def newest_first() -> list[Column]:
    return [F.col("inserted_at").desc(), F.col("alert_id").desc()]


def feed_limit(requested: int | str | None) -> int:
    """The requested page size, the default if there is none; ValueError if it is not an allowed one."""
    if requested is None:
        return FEED_DEFAULT
    size = int(requested)
    if size not in FEED_LIMITS:
        raise ValueError(f"page size {size}: allowed are {sorted(FEED_LIMITS)}")
    return size


def of_ip(rows: DataFrame, ip: str | None, column: str = "src_ip") -> DataFrame:
    """The rows of one IP, or all if it is None."""
    return rows if ip is None else rows.filter(F.col(column) == ip)


def of_day(live: DataFrame, day: date | str | None, ip: str | None = None) -> DataFrame:
    """Live alerts of a day (of all days if it is None), of one IP if one is given. Prunes partitions by day."""
    rows = live if day is None else live.filter(F.col("alert_date") == F.lit(str(day)).cast("date"))
    return of_ip(rows, ip, "source_ip")


def _iso(time: Column) -> Column:
    whole = F.pmod(F.unix_micros(time), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def _feed_columns(live: DataFrame, *extra: str) -> DataFrame:
    shown = F.coalesce("inserted_at", "event_time")
    return live.select(
        *extra,
        F.coalesce(F.date_format(shown, "HH:mm:ss"), F.lit("N/A")).alias("display_time"),
        _iso(shown).alias("raw_time"),
        "alert_type",
        F.col("source_ip").alias("src_ip"),
        "dest_ip",
        "protocol",
        F.col("request_path").alias("path"),
        "count_value",
        "user_agent",
    )


def live_feed(live: DataFrame, day: date | str | None, limit: int = FEED_DEFAULT, ip: str | None = None) -> DataFrame:
    """The newest alerts of a day, newest first."""
    return _feed_columns(of_day(live, day, ip).orderBy(*newest_first()).limit(limit))


def live_feed_page(
    live: DataFrame, day: date | str | None, page: int, page_size: int = FEED_DEFAULT
) -> DataFrame:
    """One page of the alerts of a day, newest first, with its number, the page count and the position of each row.

    Pages count from 1; a lower number raises ValueError, one beyond the last page gives no rows.
    """
    if page < 1 or page_size < 1:
        raise ValueError("pages and their size count from 1")
    rows = of_day(live, day)
    total = rows.agg(F.count("*").alias("n")).scalar()
    before = (page - 1) * page_size
    # At most one page of rows is left, so one task may number them.
    shown = newest(rows, before + page_size, ("inserted_at",), (), last=("alert_id",)).offset(before).withColumns(
        {
            "position": (F.row_number().over(Window.orderBy(*newest_first())) + before).cast("long"),
            "pages": F.ceil(total / page_size).cast("long"),
            "page": F.lit(page).cast("long"),
        }
    )
    return _feed_columns(shown, "page", "pages", "position")


def live_count_by_day(live: DataFrame) -> DataFrame:
    return live.groupBy("alert_date").agg(F.count("*").alias("alerts"))


def live_kpis(live: DataFrame, day: date | str | None, loaded: int | None = None) -> DataFrame:
    """One row: alerts of the day, and of all of them, or of the newest `loaded`, the distinct sources and the newest time."""
    rows = of_day(live, day)
    newest_rows = rows if loaded is None else rows.orderBy(*newest_first()).limit(loaded)
    total = rows.agg(F.count("*").alias("live_total"))
    return newest_rows.agg(
        F.count("*").alias("loaded"),
        F.count_distinct("source_ip").alias("live_ips"),
        F.coalesce(F.date_format(F.max(F.coalesce("inserted_at", "event_time")), "HH:mm:ss"), F.lit("--:--:--")).alias(
            "live_last"
        ),
    ).withColumn("live_total", total.scalar())


def _live_rollup(live: DataFrame) -> DataFrame:
    return live.groupBy(F.col("source_ip").alias("src_ip"), "dest_ip", "protocol", "alert_type").agg(
        F.count("*").alias("alerts"), F.max(F.coalesce("inserted_at", "event_time")).alias("last_seen")
    )


def live_summary(live: DataFrame, day: date | str | None) -> DataFrame:
    """One row per IP: live alerts, newest time, distinct real targets and protocols, alerts of the five families.

    It counts every alert it is given; give `of_day(...)` cut to the newest rows of one IP for a summary of those.
    """

    def real(column: str) -> Column:
        return F.when(~F.col(column).isin(NO_VALUE, ""), F.col(column))

    families = live_family_conditions(F.col("alert_type"))
    return (
        _live_rollup(of_day(live, day))
        .groupBy("src_ip")
        .agg(
            F.sum("alerts").alias("active_alerts"),
            F.max("last_seen").alias("last_seen"),
            F.count_distinct(real("dest_ip")).alias("unique_targets_live"),
            F.count_distinct(real("protocol")).alias("unique_protocols_live"),
            *[
                F.sum(F.when(condition, F.col("alerts")).otherwise(0)).alias(f"{family}_live")
                for family, condition in families.items()
            ],
        )
    )


def live_dimension_counts(live: DataFrame, day: date | str | None) -> DataFrame:
    """Live alerts per IP and value of each dimension (alert_type, protocol, dest_ip); no value counts as `-`."""
    cells = _live_rollup(of_day(live, day)).unpivot(
        ["src_ip", "alerts"], ["alert_type", "protocol", "dest_ip"], "dimension", "value"
    )
    value = F.when(F.col("value") != "", F.col("value")).otherwise(NO_VALUE)
    return cells.groupBy("src_ip", "dimension", value.alias("value")).agg(F.sum("alerts").alias("alerts"))


def live_newest_per_ip(
    live: DataFrame, day: date | str | None, limit: int | None = SUMMARY_ALERTS, ip: str | None = None
) -> DataFrame:
    """The newest alerts of every IP, or of one, with their position."""
    return _feed_columns(top_per_key(of_day(live, day, ip), "source_ip", newest_first(), limit), "position")


def risk_distribution(reputation: DataFrame) -> DataFrame:
    """IPs per risk level, always four rows; an unknown level is recomputed from the score."""
    given = F.upper(F.coalesce(F.col("risk_level"), F.lit("LOW")))
    score = whole_or_zero(F.col("risk_score").cast("string"))
    level = F.when(given.isin(*RISK_LEVELS), given).otherwise(risk_level(score))
    counts = reputation.select(level.alias("level")).agg(
        *[F.count_if(F.col("level") == name).alias(name) for name in RISK_LEVELS]
    )
    return counts.unpivot([], list(RISK_LEVELS), "name", "value")


def with_last_live(
    rows: DataFrame, live: DataFrame, day: date | str | None, newest: int | None = None
) -> DataFrame:
    """Adds `last_live`, the newest live time of the row's IP among all alerts of the day, or among its `newest`."""
    alerts = of_day(live, day)
    if newest is not None:
        alerts = alerts.orderBy(*newest_first()).limit(newest)
    last = alerts.groupBy(F.col("source_ip").alias("src_ip")).agg(
        F.max(F.coalesce("inserted_at", "event_time")).alias("last_live")
    )
    # Bounded by `newest` rows, hence safe to broadcast; unbounded, the choice is Spark's.
    return rows.join(F.broadcast(last) if newest is not None else last, "src_ip", "left")


HISTORICAL_COUNTS = tuple(f"{name}_count" for name in (*LABELS, *ATTACKS))
LIVE_COUNTS = (
    "active_alerts", "unique_targets_live", "unique_protocols_live", "scan_live", "sqli_live", "xss_live",
    "bruteforce_live", "exfiltration_live",
)


def ip_profile(reputation: DataFrame, ip_stats: DataFrame, summary: DataFrame, ip: str | None = None) -> DataFrame:
    """One row per IP known to the batch or the live side, or the row of one.

    Counts come from the reputation, else from `global_ip_stats` (which may be of another day), else they are 0; then the
    combined totals of both sides and the recommendation. All three are grouped by IP, so their joins need no shuffle of
    their own.
    """
    reputation, ip_stats, summary = (of_ip(rows, ip) for rows in (reputation, ip_stats, summary))
    fallback = ip_stats.select(
        "src_ip",
        F.col("alert_count").alias("_total_alerts"),
        *[F.col(name).alias(f"_{name}") for name in HISTORICAL_COUNTS],
    )
    known = reputation.select(
        "src_ip", "risk_score", "risk_level", "unique_targets", "unique_protocols", "total_alerts", *HISTORICAL_COUNTS
    ).withColumn("_batch", F.lit(True))
    joined = known.join(summary, "src_ip", "full").join(fallback, "src_ip", "left")

    def historical(name: str) -> Column:
        return F.coalesce(F.col(name), F.col(f"_{name}"), F.lit(0).cast("long"))

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    origin = (
        F.when(F.col("_batch"), "ip_reputation").when(F.col("_total_alerts").isNotNull(), "global_ip_stats").otherwise("none")
    )
    profile = joined.select(
        "src_ip",
        origin.alias("historical_source"),
        zero("risk_score").alias("risk_score"),
        "risk_level",
        zero("unique_targets").alias("unique_targets"),
        zero("unique_protocols").alias("unique_protocols"),
        historical("total_alerts").alias("total_alerts"),
        *[historical(name).alias(name) for name in HISTORICAL_COUNTS],
        F.col("last_seen").alias("last_live"),
        *[zero(name).alias(name) for name in LIVE_COUNTS],
    )
    return with_recommendation(with_combined_totals(profile))


def with_combined_totals(profile: DataFrame) -> DataFrame:
    """Adds batch plus live totals. The two sides classify differently (see `live_family_conditions`); targets and
    protocols are not added up, because the same one can be on both sides."""
    return profile.withColumns(
        {
            "total_alerts_visible": F.col("total_alerts") + F.col("active_alerts"),
            "scan_total_visible": F.col("scan_count") + F.col("scan_live"),
            "sqli_total_visible": F.col("sqli_count") + F.col("sqli_live"),
            "xss_total_visible": F.col("xss_count") + F.col("xss_live"),
        }
    )


def with_recommendation(profile: DataFrame) -> DataFrame:
    """Adds the recommended level, action and reason."""
    level = recommendation(F.col("risk_score"), F.col("active_alerts"), F.col("sqli_live"), F.col("scan_live"))
    return profile.withColumn("recommended_level", level).withColumns(
        {
            "recommended_action": recommended_action(F.col("recommended_level")),
            "recommendation_reason": recommendation_reason(F.col("recommended_level")),
        }
    )


def signal_matrix(profile: DataFrame) -> DataFrame:
    """Per IP the signals that occur at all: label, batch count, live count and total."""
    signals = F.array(
        *[
            F.struct(
                F.lit(label).alias("signal"),
                F.col(batch).alias("batch"),
                (F.col(live) if live else F.lit(0).cast("long")).alias("live"),
            )
            for label, batch, live in SIGNALS
        ]
    )
    rows = profile.select("src_ip", F.inline(signals))
    return rows.withColumn("total", F.col("batch") + F.col("live")).filter(F.col("total") >= 1)


def ip_relations(pairs: DataFrame, limit: int | None = RELATIONS_PER_IP, ip: str | None = None) -> DataFrame:
    """The worst relations of every IP, or of one, with their position. Takes all pairs."""
    order = [F.col("relation_risk_score").desc(), F.col("alert_count").desc(), F.col("dest_ip").asc()]
    return top_per_key(of_ip(pairs, ip), "src_ip", order, limit)


def ip_top_types(types: DataFrame, limit: int | None = TYPES_PER_IP, ip: str | None = None) -> DataFrame:
    """The most frequent alert types of every IP, or of one, with their position."""
    return top_per_key(of_ip(types, ip), "src_ip", [F.col("alert_count").desc(), F.col("alert_type").asc()], limit)


def ip_recent_history(history: DataFrame, limit: int | None = HISTORY_PER_IP, ip: str | None = None) -> DataFrame:
    """The newest alerts of every IP, or of one, with their position."""
    order = [*view_order("ip_historical_alerts"), F.col("bytes_transferred").asc()]
    return top_per_key(of_ip(history, ip), "src_ip", order, limit)


def ip_history(history: DataFrame, ip: str, limit: int = HISTORY_PER_IP) -> DataFrame:
    """The newest alerts of one IP from the keyed history."""
    rows = history.filter(F.col("row_key").startswith(f"{ip}|"))
    return rows.orderBy(*view_order("ip_historical_alerts"), F.col("bytes_transferred").asc()).limit(limit)


def timeline_tail(timeline: DataFrame, points: int = TIMELINE_POINTS) -> DataFrame:
    """The last buckets of the timeline, oldest first."""
    return timeline.orderBy(F.col("time_bucket").desc()).limit(points).orderBy("time_bucket")


def top_by_number(view: DataFrame, field: str, limit: int, *tie: str) -> DataFrame:
    """The first rows of a text view by the number in a field; unreadable text counts as 0."""
    return view.orderBy(number_or_zero(F.col(field)).desc(), *[F.col(name).asc() for name in tie]).limit(limit)


def top_lists(views: dict[str, DataFrame], lists: dict[str, tuple[str, int]]) -> DataFrame:
    """Several top lists in one frame: list, position, row key and value."""
    result = None
    for name, (field, limit) in lists.items():
        rows = with_row_key(name, views[name]).select(
            F.lit(name).alias("list"), "row_key", F.col(field).cast("long").alias("value")
        )
        best = Window.orderBy(F.col("value").desc(), F.col("row_key").asc())
        # The limit comes first: at most `limit` rows are numbered by one task.
        top = rows.orderBy(F.col("value").desc(), F.col("row_key").asc()).limit(limit)
        top = top.withColumn("position", F.row_number().over(best).cast("long"))
        result = top if result is None else result.unionByName(top)
    return result


def analytics_kpis(
    rolled: DataFrame, reputation: DataFrame, pairs: DataFrame, timeline: DataFrame, patterns: DataFrame, protocols: DataFrame
) -> DataFrame:
    """The counters beside the lists, one row each. They count whole views, before any top list is cut."""
    counts = row_counts(
        ip_reputation=reputation,
        high_risk_ips=high_risk_ips(reputation, limit=None),
        attacker_victim_stats=pairs,
        threat_timeline=timeline,
        global_attack_patterns=patterns,
        global_protocol_stats=protocols,
    )
    targets = total_unique_targets(rolled).select(
        F.lit("target_ip_stats").alias("table"), F.col("total_unique_targets").alias("rows")
    )
    return counts.unionByName(targets)
