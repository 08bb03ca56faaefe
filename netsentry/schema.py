"""Schemas of the log events and of the two alert shapes."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("threat_label", T.StringType()),
        T.StructField("log_type", T.StringType()),
        T.StructField("bytes_transferred", T.IntegerType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("request_path", T.StringType()),
    ]
)

LOG_COLUMNS = tuple(LOG_SCHEMA.fieldNames())

ARCHIVE_PARTITIONS = ("year", "month", "day", "hour")

BATCH_ALERT_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("archived_at", T.TimestampType()),
        T.StructField("bytes_transferred", T.LongType()),
        T.StructField("threat_label", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)

# count_value is a long: a 10-second byte total can pass 2 GiB.
LIVE_ALERT_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("count_value", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)

# The stored live table: the live alert under its stored names plus the insert-time columns.
LIVE_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("alert_date", T.DateType()),
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("alert_id", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("request_path", T.StringType()),
        T.StructField("count_value", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("user_agent", T.StringType()),
    ]
)
