"""The log archive: Parquet partitioned by year, month, day and hour of the event time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.schema import ARCHIVE_PARTITIONS
from netsentry.sources.logs import with_date_parts


def write_archive(logs: DataFrame, path: str, files_per_write: int | None = None) -> None:
    """Appends logs to the archive. `files_per_write` spreads the rows evenly over that many tasks first, however
    many of them fall into one hour, which bounds the number of files."""
    rows = logs if files_per_write is None else logs.repartition(files_per_write)
    with_date_parts(rows).write.mode("append").partitionBy(*ARCHIVE_PARTITIONS).parquet(path)


def _hour_number(year, month, day, hour):
    return ((year * 100 + month) * 100 + day) * 100 + hour


def read_archive(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Archived logs with `start <= event_time < end`.

    Partition discovery stays on, so the bounds prune whole hours before any file is opened; the exact bound on
    event_time is pushed to the Parquet reader. Rows without an event time are only in unbounded reads.
    """
    logs = spark.read.parquet(path)
    parts = _hour_number(*[F.col(name) for name in ARCHIVE_PARTITIONS])
    if start is not None:
        first = _hour_number(start.year, start.month, start.day, start.hour)
        logs = logs.filter((parts >= first) & (F.col("event_time") >= F.lit(start.isoformat(" ")).cast("timestamp")))
    if end is not None:
        before = end - timedelta(microseconds=1)
        last = _hour_number(before.year, before.month, before.day, before.hour)
        logs = logs.filter((parts <= last) & (F.col("event_time") < F.lit(end.isoformat(" ")).cast("timestamp")))
    return logs
