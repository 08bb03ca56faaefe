"""The live alert table: insert-time columns, retention and reading it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsentry.functions.text import identity_hash, text_cell
from netsentry.operators import detect
from netsentry.rules import LIVE_RETENTION_HOURS, VOLUME_MIN_BYTES
from netsentry.schema import LIVE_TABLE_SCHEMA


def stored(alerts: DataFrame, inserted_at: Column | None = None, message: tuple[str, ...] = ()) -> DataFrame:
    """Live alerts in their stored form, `LIVE_TABLE_SCHEMA`.

    Missing text becomes `-` and a missing event time the insert time. The id is a hash of the alert, so a retried
    write produces the same id again. With the columns `message`, which tell one log message from another (its sender's
    `position`), in the hash, two equal events are two alerts, and an event that is sent again is the same one.
    """
    now = F.current_timestamp() if inserted_at is None else inserted_at
    rows = alerts.withColumn("inserted_at", now).select(
        F.to_date("inserted_at").alias("alert_date"),
        "inserted_at",
        F.col("src_ip").alias("source_ip"),
        text_cell(F.col("dest_ip")).alias("dest_ip"),
        "alert_type",
        text_cell(F.col("path")).alias("request_path"),
        "count_value",
        F.coalesce("event_time", "inserted_at").alias("event_time"),
        text_cell(F.col("protocol")).alias("protocol"),
        text_cell(F.col("user_agent")).alias("user_agent"),
        *message,
    )
    identity = ("source_ip", "dest_ip", "protocol", "user_agent", "request_path", "alert_type", "count_value", "event_time")
    return rows.withColumn("alert_id", identity_hash(*identity, *message)).select(*LIVE_TABLE_SCHEMA.fieldNames())


def replay(logs: DataFrame, volume_threshold: int = VOLUME_MIN_BYTES) -> DataFrame:
    """The live table as a replay of finished logs fills it: every window counts as closed and each alert is
    inserted at the end of the minute of its event time."""
    alerts = (
        detect.live_signature(logs)
        .unionByName(detect.live_repeated_blocked(logs))
        .unionByName(detect.live_volume(logs, threshold=volume_threshold))
    )
    return stored(alerts, F.date_trunc("minute", "event_time") + F.expr("INTERVAL 1 MINUTE"))


def retained(live: DataFrame, now: Column, hours: int = LIVE_RETENTION_HOURS) -> DataFrame:
    """Alerts not older than the retention. The bound on `alert_date` prunes whole partitions of a stored table."""
    oldest = now - F.make_dt_interval(hours=F.lit(hours))
    return live.filter((F.col("alert_date") >= F.to_date(oldest)) & (F.col("inserted_at") > oldest))
