"""The named queries, each from the folder of the input tables to its result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.functions.classify import display_family
from netsentry.functions.match import signature_type
from netsentry.functions.score import attack_counts_text, dominant_attack, relation_level
from netsentry.functions.text import number_or_zero
from netsentry.operators import detect, enrich, live
from netsentry.operators.rollup import rollup
from netsentry.plans import batch, delivery, serving, store, views
from netsentry.rules import LIVE_RETENTION_HOURS
from netsentry.schema import LOG_COLUMNS
from netsentry.session import work_dir
from netsentry.sources import archive, logs
from netsentry.sources.netlog import netlog
from netsentry.streaming import jobs

# Parameters of the queries.
DAY = "2024-01-01"  # the day of the live reads
NOW = "2024-01-02 00:10:00"  # the clock of the retention
RETAINED_FROM = date(2024, 1, 2)  # first day that the retention leaves
IP = "185.10.10.5"  # the address of the single-IP reads
ARCHIVE_FROM, ARCHIVE_TO = datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1)
LIVE_VOLUME_BYTES = 400_000  # live byte threshold, low enough for the data at hand

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    """Times and dates as text, so that any engine prints the same."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd").alias(field.name)
        columns.append(column)
    return df.select(*columns)


class Inputs:
    """The frames the queries start from; nothing is read before a query asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def raw_logs(self) -> DataFrame:
        return netlog(self.table("events"))

    def logs(self) -> DataFrame:
        return logs.prepare(self.raw_logs())

    def alerts(self) -> DataFrame:
        return detect.all_alerts(self.logs())

    def rollup(self) -> DataFrame:
        return rollup(self.alerts())

    def reputation(self) -> DataFrame:
        return views.ip_reputation(self.rollup())

    def live(self) -> DataFrame:
        return live.replay(self.logs(), LIVE_VOLUME_BYTES)

    def stored_alerts(self) -> DataFrame:
        """For queries that read the alerts more than once."""
        return store.materialize(self.alerts(), "alerts")

    def stored_rollup(self) -> DataFrame:
        return store.materialize(self.rollup(), "rollup")

    def profile(self, ip: str | None = None) -> DataFrame:
        rolled = self.stored_rollup()
        return serving.ip_profile(
            views.ip_reputation(rolled), views.global_ip_stats(rolled, limit=None), serving.live_summary(self.live(), DAY), ip
        )

    def log_stream(self) -> DataFrame:
        events = self.table("events")
        # A glob: the table may be one file or a folder of files, and a stream takes a plain path as a folder only.
        stream = self.spark.readStream.schema(events.schema).parquet(f"{self.folder}/events.parque[t]")
        return logs.normalize(netlog(stream))


# --- sources ------------------------------------------------------------------------------------------------------


def log_to_json_roundtrip(i: Inputs) -> DataFrame:
    return logs.parse_json(logs.encode_json(i.raw_logs()), keep=("key",))


def replay_slice(i: Inputs) -> DataFrame:
    rows = i.raw_logs().select("event_id", "timestamp", "source_ip", "request_path")
    return logs.replay_slice(rows, "event_id", offset=logs.REPLAY_FIRST, rows=logs.REPLAY_NEXT)


def csv_to_alerts(i: Inputs) -> DataFrame:
    """The log written as CSV with its columns in another order and hostile paths, read back, and its signatures."""
    path = work_dir(i.spark, "csv")
    text = F.concat(F.lit('/q?a="x",'), F.col("request_path"), F.lit('\\";b'))
    raw = i.raw_logs().withColumn("request_path", text)
    raw.select(*sorted(LOG_COLUMNS, reverse=True)).write.options(header=True, quote='"', escape='"').csv(path)
    return detect.signature(logs.prepare(logs.read_log_csv(i.spark, path))).select(
        "src_ip", "dest_ip", "path", "alert_type", "event_time", "bytes_transferred"
    )


def reject_counts(i: Inputs) -> DataFrame:
    """Messages of the log, every seventh cut off in the middle, and how many of them cannot be read."""
    keyed = i.raw_logs().select("event_id", F.to_json(F.struct(*LOG_COLUMNS)).alias("value"))
    cut = F.when(F.expr("event_id % 7 = 0"), F.expr("left(value, 10)")).otherwise(F.col("value"))
    return logs.rejects(keyed.select(cut.alias("value")))


def replay_deep_slice(i: Inputs) -> DataFrame:
    """A slice near the end of the stored log, found by counts of ranges."""
    rows = store.materialize(i.raw_logs().select("event_id", "timestamp", "source_ip", "request_path"), "log")
    return logs.deep_slice(rows, "event_id", offset=rows.count() * 9 // 10, rows=logs.REPLAY_NEXT, bins=64, most=256)


def json_props_parse(i: Inputs) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    return logs.parse_json(i.table("events"), schema, "props", keep=("event_id", "event_type"))


def archive_scan_hour(i: Inputs) -> DataFrame:
    path = work_dir(i.spark, "archive")
    archive.write_archive(i.logs(), path)
    hour = archive.read_archive(i.spark, path, ARCHIVE_FROM, ARCHIVE_TO)
    return hour.groupBy(F.date_trunc("hour", "event_time").alias("hour_start")).agg(
        F.count("*").alias("logs"),
        F.count_if(F.col("action") == "blocked").alias("blocked_logs"),
        F.sum("bytes_transferred").alias("total_bytes"),
    )


def event_time_fallback(i: Inputs) -> DataFrame:
    gaps = i.raw_logs().select(
        "event_id",
        F.when(F.expr("event_id % 3 = 0"), F.col("event_time").cast("string")).alias("event_time"),
        F.when(F.expr("event_id % 5 <> 0"), F.col("timestamp")).otherwise("not a time").alias("timestamp"),
    )
    return logs.with_event_time(gaps).select("event_id", "event_time")


def live_feed_latest(i: Inputs) -> DataFrame:
    return serving.live_feed(i.live(), DAY, 100)


def live_feed_by_ip(i: Inputs) -> DataFrame:
    return serving.live_feed(i.live(), DAY, serving.LIVE_PER_IP, IP)


def _stored_view(i: Inputs, name: str, view: DataFrame) -> DataFrame:
    """A view as a reader of the store finds it: written as a version, published and read back."""
    path = work_dir(i.spark, "views")
    store.write_views({name: view}, path)
    return store.read_view(i.spark, path, name)


def view_scan(i: Inputs) -> DataFrame:
    """Every stored view, from logs to the read: the number of its rows and of its keys."""
    path = work_dir(i.spark, "views")
    batch.refresh_views(i.logs(), path)
    counts = [
        store.read_view(i.spark, path, name).agg(F.count("*").alias("rows"), F.count_distinct("row_key").alias("keys"))
        .select(F.lit(name).alias("view"), "rows", "keys")
        for name in views.VIEW_KEYS
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


VIEW_FILES = 16  # files of a view that is read by key


def view_point_lookup(i: Inputs) -> DataFrame:
    """One row of a view of many files; its key range leaves one of them."""
    path = work_dir(i.spark, "views")
    store.write_views({"ip_reputation": i.reputation()}, path, files=VIEW_FILES)
    return store.lookup_key(i.spark, path, "ip_reputation", IP).select("row_key", "src_ip", "total_alerts", "risk_score", "risk_level", "last_seen")


def view_prefix_scan(i: Inputs) -> DataFrame:
    path = work_dir(i.spark, "views")
    store.write_views({"ip_attack_types": views.ip_attack_types(i.rollup())}, path, files=VIEW_FILES)
    return store.lookup_key_prefix(i.spark, path, "ip_attack_types", IP).select("row_key", "src_ip", "alert_type", "alert_count", "last_seen")


def ip_history_prefix_scan(i: Inputs) -> DataFrame:
    history = _stored_view(i, "ip_historical_alerts", views.ip_historical_alerts(i.alerts(), limit=None))
    return serving.ip_history(history, IP).select("row_key", "src_ip", "alert_type", "event_time", "archived_at")


def view_scan_absent(i: Inputs) -> DataFrame:
    """Rows of the ten views in a store that holds two of them so far."""
    path = work_dir(i.spark, "views")
    store.register_views(i.spark, path)
    rolled = i.stored_rollup()
    store.write_views({"ip_reputation": views.ip_reputation(rolled), "target_ip_stats": views.target_ip_stats(rolled, limit=None)}, path)
    return views.row_counts(**{name: store.read_view_or_empty(i.spark, path, name) for name in views.VIEW_KEYS})


PROFILE_BUCKETS = 8


def ip_profile_bucketed(i: Inputs) -> DataFrame:
    """The profiles from views that are stored in buckets by address: their joins need no shuffle."""
    path = work_dir(i.spark, "bucketed")
    rolled = i.stored_rollup()
    inputs = {
        "ip_reputation": views.ip_reputation(rolled),
        "global_ip_stats": views.global_ip_stats(rolled, limit=None),
        "live_summary": serving.live_summary(i.live(), DAY),
    }
    for name, view in inputs.items():
        store.write_bucketed(view, f"{path}/{name}", "src_ip", PROFILE_BUCKETS)
    return serving.ip_profile(*(store.read_bucketed(i.spark, f"{path}/{name}") for name in inputs))


def ip_profile_one(i: Inputs) -> DataFrame:
    """The profile of one IP; its address filters each input before the joins."""
    return i.profile(IP)


def ip_profile_fallback(i: Inputs) -> DataFrame:
    """Profiles where the reputation is of half of the addresses only, as after a partial refresh; the others take their
    counts from `global_ip_stats`."""
    rolled = i.stored_rollup()
    half = views.ip_reputation(rolled).filter(F.substring_index("src_ip", ".", -1).cast("int") % 2 == 0)
    stats = views.global_ip_stats(rolled, limit=None)
    profile = serving.ip_profile(half, stats, serving.live_summary(i.live(), DAY))
    return profile.select("src_ip", "historical_source", "total_alerts", "risk_score", "sqli_count", "active_alerts", "total_alerts_visible")


def ip_one(i: Inputs) -> DataFrame:
    """Relations, types, history and newest live alerts of one IP: part, position and what stands there."""
    alerts = i.stored_alerts()
    rolled = rollup(alerts)
    parts = {
        "relations": (serving.ip_relations(views.attacker_victim_stats(rolled, limit=None), ip=IP), "dest_ip"),
        "types": (serving.ip_top_types(views.ip_attack_types(rolled), ip=IP), "alert_type"),
        "history": (serving.ip_recent_history(views.ip_historical_alerts(alerts, limit=None), ip=IP), "row_hash"),
        "live": (serving.live_newest_per_ip(i.live(), DAY, ip=IP), "alert_type"),
    }
    result = None
    for name, (rows, value) in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "position", F.col(value).alias("value"))
        result = rows if result is None else result.unionByName(rows)
    return result


# --- sinks --------------------------------------------------------------------------------------------------------


STREAM_SECONDS = 3_600  # a stream over the whole table that takes longer has hung


def _await(query) -> None:
    if not query.awaitTermination(STREAM_SECONDS):
        query.stop()
        raise TimeoutError(f"the stream {query.name} has not ended")
    if query.exception() is not None:
        raise query.exception()


def stream_archive_counts(i: Inputs) -> DataFrame:
    base = work_dir(i.spark, "archive-stream")
    path = f"{base}/table"
    _await(jobs.start_archive(i.log_stream(), path, f"{base}/checkpoint", trigger={"availableNow": True}))
    return (
        archive.read_archive(i.spark, path)
        .groupBy(*[F.col(name).cast("long").alias(name) for name in archive.ARCHIVE_PARTITIONS])
        .agg(F.count("*").alias("logs"), F.sum("bytes_transferred").alias("total_bytes"))
    )


def _streamed_alerts(i: Inputs, names: tuple[str, ...] = jobs.DETECTORS) -> dict[str, DataFrame]:
    base = work_dir(i.spark, "alert-stream")
    streams = jobs.alert_streams(i.log_stream(), "event_time", LIVE_VOLUME_BYTES)
    started = [
        jobs.start_alert(name, streams[name], f"{base}/live", f"{base}/checkpoint", {"availableNow": True})
        for name in names
    ]
    for query in started:
        _await(query)
    return {name: jobs.read_detector(i.spark, f"{base}/live", name) for name in names}


def stream_alert_sink(i: Inputs) -> DataFrame:
    parts = list(_streamed_alerts(i).values())
    alerts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return alerts.groupBy("alert_type").agg(F.count("*").alias("alerts"), F.max("event_time").alias("last_event"))


def live_compaction_counts(i: Inputs) -> DataFrame:
    """The live table as three streams write it, compacted and read back."""
    base = work_dir(i.spark, "live")
    streams = jobs.alert_streams(i.log_stream(), "event_time", LIVE_VOLUME_BYTES)
    started = [jobs.start_alert(n, s, f"{base}/live", f"{base}/checkpoint", {"availableNow": True}) for n, s in streams.items()]
    for query in started:
        _await(query)
    jobs.compact_live(i.spark, f"{base}/live", f"{base}/compact")
    alerts = jobs.read_compacted(i.spark, f"{base}/compact")
    return alerts.groupBy("alert_type", "source_ip").agg(F.count("*").alias("alerts"), F.max("event_time").alias("last_event"))


def expired_partitions(i: Inputs) -> DataFrame:
    """The live table spread over three days, after the partitions older than the retention have been dropped."""
    path = work_dir(i.spark, "live-days")
    spread = i.live().withColumn("alert_date", F.date_add("alert_date", F.length("source_ip") % 3))
    spread.write.partitionBy("alert_date").parquet(path)
    store.drop_expired_days(i.spark, path, RETAINED_FROM)
    kept = jobs.read_compacted(i.spark, path)
    return kept.groupBy("alert_date").agg(F.count("*").alias("alerts"), F.count_distinct("source_ip").alias("sources"))


def live_expired_rows(i: Inputs) -> DataFrame:
    """The live table after the rows older than the retention have been deleted, read without a filter."""
    path = work_dir(i.spark, "live-days")
    i.live().write.partitionBy("alert_date").parquet(path)
    store.drop_expired(i.spark, path, datetime.fromisoformat(NOW) - timedelta(hours=LIVE_RETENTION_HOURS))
    return jobs.read_compacted(i.spark, path).select("alert_id", "source_ip", "alert_type", "inserted_at")


def alert_null_defaults(i: Inputs) -> DataFrame:
    def gap(column: str, every: int):
        return F.when(F.expr(f"event_id % {every} <> 0"), F.col(column)).alias(column)

    typed = i.logs().withColumn(
        "alert_type", signature_type(F.lower("user_agent"), F.lower("request_path"))
    ).filter(F.col("alert_type").isNotNull())
    gaps = typed.select(
        F.col("source_ip").alias("src_ip"),
        "alert_type",
        "archived_at",
        gap("dest_ip", 2),
        gap("request_path", 3).alias("path"),
        gap("protocol", 5),
        gap("user_agent", 7),
        gap("event_time", 11),
        F.lit(None).cast("long").alias("count_value"),
    )
    return live.stored(gaps, F.col("archived_at")).drop("count_value")


def view_export_text(i: Inputs) -> DataFrame:
    return store.export_text(views.with_row_key("ip_reputation", i.reputation()))


def _views(i: Inputs) -> dict[str, DataFrame]:
    alerts = i.stored_alerts()
    return views.all_views(alerts, store.materialize(rollup(alerts), "rollup"))


def view_row_keys(i: Inputs) -> DataFrame:
    result = None
    for name, view in _views(i).items():
        keys = views.with_row_key(name, view).select(F.lit(name).alias("view"), "row_key")
        result = keys if result is None else result.unionByName(keys)
    return result


def kpi_total_unique_targets(i: Inputs) -> DataFrame:
    return views.total_unique_targets(i.alerts())


def view_kpi_row(i: Inputs) -> DataFrame:
    rolled = i.rollup()
    targets = views.with_row_key("target_ip_stats", views.target_ip_stats(rolled, limit=None))
    text = store.export_text(targets.select("row_key", "alert_count", "target_risk_score"))
    return store.with_kpi_row(text, views.total_unique_targets(rolled))


def live_retention_24h(i: Inputs) -> DataFrame:
    kept = live.retained(i.live(), F.lit(NOW).cast("timestamp"))
    return kept.select("alert_id", "source_ip", "alert_type", "inserted_at")


# --- projections --------------------------------------------------------------------------------------------------


def archive_date_parts(i: Inputs) -> DataFrame:
    parts = logs.with_date_parts(i.raw_logs())
    return parts.select("event_id", *[F.col(name).cast("long").alias(name) for name in archive.ARCHIVE_PARTITIONS])


def normalize_logs(i: Inputs) -> DataFrame:
    return i.logs().select(
        "event_id", "source_ip", "dest_ip", "protocol", "action", "threat_label", "user_agent", "request_path",
        "bytes_transferred",
    )


def alert_category(i: Inputs) -> DataFrame:
    return enrich.categorize(i.alerts()).groupBy("alert_type", "attack_category").agg(F.count("*").alias("alerts"))


def alert_flags(i: Inputs) -> DataFrame:
    flagged = enrich.with_indicators(enrich.categorize(i.alerts()))
    flags = [name for name in flagged.columns if name.startswith("is_")]
    return flagged.select("src_ip", "alert_type", "threat_label", "action", "event_time", *flags)


def alert_row_hash(i: Inputs) -> DataFrame:
    return enrich.with_row_hash(i.alerts()).select("row_hash", "alert_type", "bytes_transferred")


def alert_display_family(i: Inputs) -> DataFrame:
    return (
        i.alerts()
        .groupBy("alert_type")
        .agg(F.count("*").alias("alerts"))
        .select("alert_type", display_family(F.col("alert_type")).alias("family"), "alerts")
    )


def relation_levels(i: Inputs) -> DataFrame:
    pairs = views.attacker_victim_stats(i.rollup(), limit=None)
    return pairs.select("src_ip", "dest_ip", "relation_risk_score", relation_level(F.col("relation_risk_score")).alias("level"))


def target_dominant_type(i: Inputs) -> DataFrame:
    return views.target_ip_stats(i.rollup(), limit=None).select("dest_ip", dominant_attack().alias("dominant_type"))


def target_type_text(i: Inputs) -> DataFrame:
    return views.target_ip_stats(i.rollup(), limit=None).select("dest_ip", attack_counts_text().alias("types"))


# --- detectors ----------------------------------------------------------------------------------------------------


def _count_types(alerts: DataFrame, name: str = "alerts") -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count("*").alias(name))


def page_signature_counts(i: Inputs) -> DataFrame:
    pages = i.table("pages").select(F.lower("html").alias("text"))
    typed = pages.select(F.explode(F.array(signature_type(None, F.col("text")))).alias("alert_type"))
    return _count_types(typed.filter(F.col("alert_type").isNotNull()), "pages")


def all_alerts_by_type(i: Inputs) -> DataFrame:
    return i.alerts().groupBy("alert_type").agg(
        F.count("*").alias("alerts"), F.sum("bytes_transferred").alias("total_bytes")
    )


def _stream_windows(i: Inputs, name: str) -> DataFrame:
    alerts = _streamed_alerts(i, (name,))[name]
    return alerts.select(F.col("source_ip").alias("src_ip"), "protocol", "count_value", "event_time")


def _live_windows(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.col("src_ip").alias("source_ip"), "protocol", "count_value", "event_time")


# --- serving ------------------------------------------------------------------------------------------------------


def reputation_with_last_live(i: Inputs) -> DataFrame:
    rows = serving.with_last_live(i.reputation(), i.live(), DAY)
    return rows.select("src_ip", "risk_score", "risk_level", "total_alerts", "last_live")


def analytics_kpis(i: Inputs) -> DataFrame:
    alerts = i.stored_alerts()
    rolled = store.materialize(rollup(alerts), "rollup")
    return serving.analytics_kpis(
        rolled,
        views.ip_reputation(rolled),
        views.attacker_victim_stats(rolled, limit=None),
        views.threat_timeline(alerts),
        views.global_attack_patterns(rolled),
        views.global_protocol_stats(rolled),
    )


def sort_text_numeric(i: Inputs) -> DataFrame:
    marked = i.reputation().select(
        F.col("src_ip").alias("row_key"),
        F.when(F.expr("total_alerts % 7 = 0"), F.lit(None))
        .when(F.expr("total_alerts % 11 = 0"), "n/a")
        .otherwise(F.col("risk_score").cast("string"))
        .alias("risk_score"),
    )
    cells = store.export_text(marked)
    top = serving.top_by_number(cells, "risk_score", 100, "row_key")
    return top.withColumn("number", number_or_zero(F.col("risk_score")))


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # sources
    "log_to_json_roundtrip": log_to_json_roundtrip,
    "replay_slice": replay_slice,
    "replay_deep_slice": replay_deep_slice,
    "json_props_parse": json_props_parse,
    "archive_scan_hour": archive_scan_hour,
    "event_time_fallback": event_time_fallback,
    "live_feed_latest": live_feed_latest,
    "live_feed_by_ip": live_feed_by_ip,
    "csv_to_alerts": csv_to_alerts,
    "reject_counts": reject_counts,
    "view_scan": view_scan,
    "view_scan_absent": view_scan_absent,
    "view_point_lookup": view_point_lookup,
    "view_prefix_scan": view_prefix_scan,
    "ip_history_prefix_scan": ip_history_prefix_scan,
    # sinks
    "stream_archive_counts": stream_archive_counts,
    "stream_alert_sink": stream_alert_sink,
    "live_compaction_counts": live_compaction_counts,
    "expired_partitions": expired_partitions,
    "alert_null_defaults": alert_null_defaults,
    "view_export_text": view_export_text,
    "view_row_keys": view_row_keys,
    "kpi_total_unique_targets": kpi_total_unique_targets,
    "view_kpi_row": view_kpi_row,
    "live_retention_24h": live_retention_24h,
    "live_expired_rows": live_expired_rows,
    # projections
    "archive_date_parts": archive_date_parts,
    "normalize_logs": normalize_logs,
    "alert_category": alert_category,
    "alert_flags": alert_flags,
    "alert_row_hash": alert_row_hash,
    "alert_display_family": alert_display_family,
    "relation_level": relation_levels,
    "target_dominant_type": target_dominant_type,
    "target_type_text": target_type_text,
    # detectors
    "signature_alerts": lambda i: detect.signature(i.logs()),
    "signature_alert_counts": lambda i: _count_types(detect.signature(i.logs())),
    "page_signature_counts": page_signature_counts,
    "repeated_blocked_alerts": lambda i: detect.repeated_blocked(i.logs()),
    "volume_alerts": lambda i: detect.volume_total(i.logs()),
    "activity_alerts": lambda i: detect.activity(i.logs()),
    "all_alerts_by_type": all_alerts_by_type,
    "live_blocked_windows": lambda i: _live_windows(detect.live_repeated_blocked(i.logs())),
    "live_volume_windows": lambda i: _live_windows(detect.live_volume(i.logs(), threshold=LIVE_VOLUME_BYTES)),
    "stream_signature_counts": lambda i: _count_types(_streamed_alerts(i, ("signature",))["signature"]),
    "stream_repeated_blocked": lambda i: _stream_windows(i, "repeated_blocked"),
    "stream_volume": lambda i: _stream_windows(i, "volume"),
    # views
    "ip_reputation": lambda i: views.ordered("ip_reputation", i.reputation()),
    "global_ip_stats": lambda i: views.global_ip_stats(i.rollup()),
    "global_protocol_stats": lambda i: views.ordered("global_protocol_stats", views.global_protocol_stats(i.rollup())),
    "global_attack_patterns": lambda i: views.ordered("global_attack_patterns", views.global_attack_patterns(i.rollup())),
    "ip_attack_types": lambda i: views.ordered("ip_attack_types", views.ip_attack_types(i.rollup())),
    "target_ip_stats": lambda i: views.target_ip_stats(i.rollup()),
    "threat_timeline": lambda i: views.ordered("threat_timeline", views.threat_timeline(i.alerts())),
    "ip_historical_alerts": lambda i: views.ip_historical_alerts(i.stored_alerts()),
    "ip_historical_newest_500": lambda i: views.ip_historical_alerts(i.stored_alerts(), limit=500),
    "attacker_victim_stats": lambda i: views.attacker_victim_stats(i.rollup()),
    "high_risk_ips": lambda i: views.high_risk_ips(i.reputation()),
    "log_and_alert_counts": lambda i: views.row_counts(logs=i.logs(), alerts=i.alerts()),
    # serving
    "live_count_by_day": lambda i: serving.live_count_by_day(i.live()),
    "live_kpis": lambda i: serving.live_kpis(i.live(), DAY),
    "live_summary_by_ip": lambda i: serving.live_summary(i.live(), DAY),
    "live_dimension_counts": lambda i: serving.live_dimension_counts(i.live(), DAY),
    "live_newest_per_ip": lambda i: serving.live_newest_per_ip(i.live(), DAY),
    "live_feed_page": lambda i: serving.live_feed_page(store.materialize(i.live(), "live"), DAY, page=3),
    "risk_distribution": lambda i: serving.risk_distribution(i.reputation()),
    "reputation_with_last_live": reputation_with_last_live,
    "ip_profile": lambda i: i.profile(),
    "ip_profile_bucketed": ip_profile_bucketed,
    "ip_profile_one": ip_profile_one,
    "ip_profile_fallback": ip_profile_fallback,
    "ip_one": ip_one,
    "ip_recommendation": lambda i: i.profile().select(
        "src_ip", "risk_score", "active_alerts", "recommended_level", "recommended_action", "recommendation_reason"
    ),
    "ip_combined_totals": lambda i: i.profile().select(
        "src_ip", "total_alerts_visible", "scan_total_visible", "sqli_total_visible", "xss_total_visible"
    ),
    "ip_signal_matrix": lambda i: serving.signal_matrix(i.profile()),
    "ip_relations": lambda i: serving.ip_relations(views.attacker_victim_stats(i.rollup(), limit=None)),
    "ip_top_types": lambda i: serving.ip_top_types(views.ip_attack_types(i.rollup())),
    "ip_recent_history": lambda i: serving.ip_recent_history(views.ip_historical_alerts(i.alerts(), limit=None)),
    "analytics_kpis": analytics_kpis,
    "analytics_lists": lambda i: serving.top_lists(_views(i), serving.ANALYTICS_LISTS),
    "global_bundle": lambda i: serving.top_lists(_views(i), serving.BUNDLE_LISTS),
    "timeline_last_24": lambda i: serving.timeline_tail(views.threat_timeline(i.alerts())),
    "sort_text_numeric": sort_text_numeric,
    # streams over several micro-batches
    **delivery.QUERIES,
}


def named_queries() -> dict[str, Query]:
    def bind(build: Callable[[Inputs], DataFrame]) -> Query:
        return lambda spark, folder: comparable(build(Inputs(spark, folder)))

    return {name: bind(build) for name, build in QUERIES.items()}
