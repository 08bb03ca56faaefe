"""The streaming jobs: archive, alerts, quarantine, and what they share with several micro-batches in mind."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from netsentry.operators import detect
from netsentry.operators.live import stored
from netsentry.rules import LIVE_RETENTION_HOURS, VOLUME_MIN_BYTES
from netsentry.schema import ARCHIVE_PARTITIONS, LIVE_TABLE_SCHEMA
from netsentry.session import STREAM_SETTINGS
from netsentry.sources.logs import normalize, parse_json, rejected, with_date_parts, with_event_time

# Triggers and watermarks.
ARCHIVE_TRIGGER = {"processingTime": "1 minute"}
ALERT_TRIGGER = {"processingTime": "1 second"}
BLOCKED_WATERMARK = "2 minutes"
VOLUME_WATERMARK = "30 seconds"
LIVE_FILE_RETENTION = f"{2 * LIVE_RETENTION_HOURS}h"
COMPACT_BYTES = 128 << 20  # alerts of a compacted file, about, before encoding and compression

DETECTORS = ("signature", "repeated_blocked", "volume")


def parse_stream(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalized log events of a message stream with `event_time`; unreadable messages and times give nulls. The columns
    `keep` of the messages (their `position`) stay."""
    return normalize(with_event_time(parse_json(messages, keep=keep)))


def once_each(logs: DataFrame, delay: str = VOLUME_WATERMARK, message: tuple[str, ...] = ("position",)) -> DataFrame:
    """Every message once, however often it is sent, and none that is later than the watermark.

    A message is told by the columns `message`, so equal events of different messages stay apart. The state keeps a
    message for `delay` of event time; one that is sent again after that is late and dropped as such. Rows are late when
    they are not newer than the watermark of the micro-batch before: the newest event time up to the second last one, less
    `delay`. Windowed sums behind it need no watermark of their own and drop no further rows.
    """
    return logs.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(message))


def batch_progress(query: StreamingQuery) -> list[dict]:
    """Of each micro-batch with input: `batch`, `rows`, `late_rows` (dropped behind the watermark) and `again` (dropped
    because the message had been seen), from the state operators' own counts. Spark keeps the last hundred batches, see
    `spark.sql.streaming.numRecentProgressUpdates`."""
    found = []
    for progress in query.recentProgress:
        if progress["numInputRows"]:
            operators = progress["stateOperators"]
            again = sum((o.get("customMetrics") or {}).get("numDroppedDuplicateRows", 0) for o in operators)
            late = sum(o["numRowsDroppedByWatermark"] for o in operators)
            found.append({"batch": progress["batchId"], "rows": progress["numInputRows"], "late_rows": late, "again": again})
    return found


def start_archive(
    logs: DataFrame, path: str, checkpoint: str, files_per_batch: int | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Appends log events, stamped with `archived_at`, to the archive partitioned by hour of the event time.

    Action and label are stored in lower case (see `parse_stream`), so that the filter on blocked events is pushed
    to the archive's files. `files_per_batch` bounds the files of a micro-batch by spreading its rows evenly.
    """
    rows = logs if files_per_batch is None else logs.repartition(files_per_batch)
    return (
        with_date_parts(rows.withColumn("archived_at", F.current_timestamp()))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*ARCHIVE_PARTITIONS)
        .outputMode("append")
        .trigger(**(trigger or ARCHIVE_TRIGGER))
        .start()
    )


def alert_streams(
    logs: DataFrame, blocked_clock: str = "detection_time", volume_threshold: int = VOLUME_MIN_BYTES
) -> dict[str, DataFrame]:
    """The three detectors as streams of live alerts.

    `blocked_clock` is the time column of the repeated-blocked windows: `detection_time`, the arrival time of the
    micro-batch, or `event_time`.
    """
    stamped = logs.withColumn("detection_time", F.current_timestamp())
    return {
        "signature": detect.live_signature(logs),
        "repeated_blocked": detect.live_repeated_blocked(stamped, blocked_clock, watermark=BLOCKED_WATERMARK),
        "volume": detect.live_volume(logs, threshold=volume_threshold, watermark=VOLUME_WATERMARK),
    }


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """`STREAM_SETTINGS` while a query starts, which takes them over then; the session's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    try:
        for key, value in STREAM_SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def start_alert(
    name: str,
    alerts: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    files_per_batch: int | None = None,
    retention: str = LIVE_FILE_RETENTION,
) -> StreamingQuery:
    """Appends one detector's alerts to its part of the live table, partitioned by `alert_date`.

    The sink commits each micro-batch once, so a retried one leaves no duplicates. Window state is kept in RocksDB.
    `files_per_batch` bounds the files of a micro-batch; files older than `retention` leave the sink's log, which would
    else grow for good, so it must be longer than the live table's own retention.
    """
    rows = stored(alerts)
    rows = rows if files_per_batch is None else rows.repartition(files_per_batch)
    writer = (
        rows.writeStream.format("parquet")
        .option("retention", retention)
        .queryName(f"alerts-{name}-{checkpoint.rstrip('/').rsplit('/', 1)[-1]}")
        .option("path", f"{path}/{name}")
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .partitionBy("alert_date")
        .outputMode("append")
        .trigger(**(trigger or ALERT_TRIGGER))
    )
    with stream_settings(alerts.sparkSession):
        return writer.start()


def start_batches(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, before_commit: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Writes each micro-batch as a folder of its own, named by its number.

    A micro-batch that is repeated after a failure has the same number and the same input, so it replaces what its first
    run left, whole or in part; nothing is written twice. `before_commit` is called with the number between the write and
    the commit: a place for a notice to others, and for a test's failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if before_commit is not None:
            before_commit(number)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or ALERT_TRIGGER))
    with stream_settings(rows.sparkSession):
        return writer.start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All micro-batches that `start_batches` has written, with their number in `batch`."""
    return spark.read.parquet(path)


def start_quarantine(
    messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, keep: tuple[str, ...] = ("key",)
) -> StreamingQuery:
    """Appends the messages that cannot be read, with the reason, beside the jobs that read the others."""
    return (
        rejected(messages, keep=keep)
        .withColumn("rejected_at", F.current_timestamp())
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("reason")
        .outputMode("append")
        .trigger(**(trigger or ARCHIVE_TRIGGER))
        .start()
    )


def stop_after(query: StreamingQuery, batches: int, seconds: float = 600) -> None:
    """Stops a query once it has finished so many micro-batches, wherever it is in the next one; a query that ends before
    has done all its work."""
    until = time.monotonic() + seconds
    while query.isActive and len([p for p in query.recentProgress if p["numInputRows"]]) < batches:
        if time.monotonic() > until:
            query.stop()
            raise TimeoutError(f"{batches} micro-batches took more than {seconds} s")
        query.awaitTermination(0.05)
    query.stop()


def start_alerts(
    logs: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    blocked_clock: str = "detection_time",
    volume_threshold: int = VOLUME_MIN_BYTES,
) -> list[StreamingQuery]:
    """Three queries, one per detector.

    They stay apart because a query has a single watermark, the lowest of its branches: in one query, old event
    times would hold back the windows on arrival time for good.
    """
    streams = alert_streams(logs, blocked_clock, volume_threshold)
    return [start_alert(name, alerts, path, checkpoint, trigger) for name, alerts in streams.items()]


def read_detector(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Committed alerts of one detector."""
    return spark.read.schema(LIVE_TABLE_SCHEMA).parquet(f"{path}/{name}").select(*LIVE_TABLE_SCHEMA.fieldNames())


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The live table: the committed alerts of the three detectors."""
    parts = [read_detector(spark, path, name) for name in DETECTORS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compact_live(spark: SparkSession, path: str, target: str, day: str | None = None, files: int | None = None) -> None:
    """Writes the committed alerts of a finished day, or of all, as few files clustered by day and source, so that a read of
    one address skips most files and row groups. A day's part of `target` is replaced, so a repeated run leaves the same table.

    `files` is the number of tasks, each of which writes a file for every day it meets. By default it follows the size, a
    task for each COMPACT_BYTES. Rows of one source and instant, however many, are divided by their place in the live table.
    """
    rows = read_live(spark, path)
    rows = rows if day is None else rows.filter(F.col("alert_date") == F.lit(day).cast("date"))
    if files is None:
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in LIVE_TABLE_SCHEMA if isinstance(f.dataType, T.StringType)]
        size = rows.agg(F.sum(sum(texts, F.lit(8 * len(LIVE_TABLE_SCHEMA)).cast("long")))).first()[0]
        files = 1 + (size or 0) // COMPACT_BYTES
    order = ("alert_date", "source_ip", "inserted_at")
    (
        rows.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(files, *order, "place")
        .sortWithinPartitions(*order)
        .drop("place")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("alert_date")
        .parquet(target)
    )


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIVE_TABLE_SCHEMA).parquet(path).select(*LIVE_TABLE_SCHEMA.fieldNames())
