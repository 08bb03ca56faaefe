"""Small log and alert frames for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from netsentry.schema import BATCH_ALERT_SCHEMA, LIVE_TABLE_SCHEMA

START = datetime(2026, 1, 5, 10, 0, 0)

LOG_COLUMNS = (
    "timestamp string, source_ip string, dest_ip string, protocol string, action string, threat_label string, "
    "log_type string, bytes_transferred bigint, user_agent string, request_path string, event_time timestamp, "
    "archived_at timestamp"
)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def log(**given):
    row = dict(
        timestamp=None, source_ip="10.9.0.1", dest_ip="10.9.1.1", protocol="TCP", action="allowed",
        threat_label="clean", log_type="ids", bytes_transferred=100, user_agent="Mozilla/5.0",
        request_path="/index.html", event_time=at(0), archived_at=at(0),
    )
    row.update(given)
    if row["timestamp"] is None and row["event_time"] is not None:
        row["timestamp"] = row["event_time"].isoformat()
    return tuple(row.values())


def logs(spark, rows):
    return spark.createDataFrame(rows, LOG_COLUMNS)


def alert(**given):
    row = dict(
        src_ip="10.9.0.1", dest_ip="10.9.1.1", protocol="TCP", path="/x", alert_type="NMAP", event_time=at(0),
        archived_at=at(0), bytes_transferred=100, threat_label="clean", action="allowed",
    )
    row.update(given)
    return tuple(row.values())


def alerts(spark, rows):
    return spark.createDataFrame(rows, BATCH_ALERT_SCHEMA)


def live_row(n: int, **given):
    row = dict(
        alert_date=at(0).date(), inserted_at=at(n), alert_id=f"id{n:05d}", source_ip="10.9.0.1", dest_ip="10.9.1.1",
        alert_type="NMAP", request_path="/x", count_value=None, event_time=at(n), protocol="TCP", user_agent="nmap",
    )
    row.update(given)
    return tuple(row.values())


def live_table(spark, rows):
    return spark.createDataFrame(rows, LIVE_TABLE_SCHEMA)


def plan(df) -> str:
    """The physical plan; after a run, the one that was run."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
