"""Views kept up to date from the archive's new files only.

A stream with the archive as its source and a checkpoint of its own gives each refresh the files that came since the last
one, whatever hours they belong to, so late events are not missed. Of each micro-batch of files these partials are stored,
in folders named by its number, which a repeated micro-batch overwrites: its signature alerts, their rollup, and the panes
of the activity detectors. All of them merge by sums, minima and maxima.

Sliding windows need more than the new files: a window reaches over `size - slide` seconds (50) of panes before the first
new one. Windows that start before that are carried over from the last version; the others are summed again from the
stored panes from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.operators import detect
from netsentry.operators.rollup import merged_rollup, rollup
from netsentry.plans.batch import write_all_views
from netsentry.plans.store import current_version, folders, materialize, new_version, publish
from netsentry.rules import BLOCKED_SLIDE_SECONDS, BLOCKED_WINDOW_SECONDS
from netsentry.sources.logs import prepare
from netsentry.streaming.jobs import stream_settings


def _part(path: str, name: str, number: int) -> str:
    return f"{path}/{name}/part={number}"


def _take(path: str):
    """Stores the partials of one micro-batch of archived logs."""

    def take(files: DataFrame, number: int) -> None:
        logs = prepare(files)
        alerts = materialize(detect.signature(logs), "signature", _part(path, "signature", number))
        materialize(rollup(alerts), "rolled", _part(path, "rolled", number))
        materialize(detect.activity_panes(logs), "panes", _part(path, "panes", number))
        counts = files.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("logs"))
        counts.write.mode("overwrite").parquet(_part(path, "reads", number))

    return take


def _parts(spark: SparkSession, path: str, name: str, after: int = -1) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").filter(F.col("part") > after)


def _last_part(spark: SparkSession, path: str) -> int:
    return max([int(f.removeprefix("part=")) for f in folders(spark, f"{path}/reads")], default=-1)


def _windows(spark: SparkSession, path: str, version: str, before: tuple[str, int] | None) -> DataFrame:
    """The stored windows with enough blocked events of this version; `before` is the last version and its last part."""
    panes = _parts(spark, path, "panes")
    if before is None:
        return materialize(detect.blocked_windows(detect.merged_panes(panes)), "windows", f"{path}/windows/version={version}")
    first_new = _parts(spark, path, "panes", before[1]).agg(F.min("pane")).first()[0]
    old = spark.read.parquet(f"{path}/windows/version={before[0]}")
    if first_new is not None:
        start = first_new - (BLOCKED_WINDOW_SECONDS - BLOCKED_SLIDE_SECONDS)
        near = detect.merged_panes(panes.filter(F.col("pane") >= start))
        fresh = detect.blocked_windows(near).filter(F.col("window_start") >= start)
        old = old.filter(F.col("window_start") < start).unionByName(fresh)
    return materialize(old, "windows", f"{path}/windows/version={version}")


def refresh_incremental(spark: SparkSession, archive_path: str, path: str, max_files: int | None = None) -> str:
    """Takes in the archive's new files and publishes all ten views as a new version; gives the version.

    The result equals a full refresh of all files. `max_files` bounds the files of a micro-batch. Without new files the
    current version stays. An archive's old files must not be rewritten: the stream would take them for new ones.
    """
    schema = spark.read.parquet(archive_path).schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.parquet(archive_path).select("*", F.col("_metadata.file_path").alias("_file"))
    writer = files.writeStream.foreachBatch(_take(path)).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    with stream_settings(spark):
        query = writer.start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()

    before = None
    if folders(spark, f"{path}/state"):
        version = current_version(spark, path)
        before = version, spark.read.parquet(f"{path}/state/version={version}").first()["last_part"]
    last = _last_part(spark, path)
    if before and before[1] == last:
        return before[0]
    version = new_version()
    windows = _windows(spark, path, version, before)
    volume = detect.volume_from_panes(_parts(spark, path, "panes"))
    activity = materialize(
        detect.blocked_from_windows(windows).unionByName(volume), "activity", f"{path}/activity/version={version}"
    )
    alerts = _parts(spark, path, "signature").drop("part").unionByName(activity)
    rolled = merged_rollup(_parts(spark, path, "rolled")).unionByName(rollup(activity))
    rolled = materialize(rolled, "rollup", f"{path}/rollup/version={version}")
    write_all_views(alerts, rolled, path, version)
    spark.range(1).select(F.lit(last).cast("bigint").alias("last_part")).coalesce(1).write.parquet(f"{path}/state/version={version}")
    publish(spark, path, version)
    return version


def files_read(spark: SparkSession, path: str) -> DataFrame:
    """(`part`, `file`, `logs`): the files that each micro-batch has read."""
    return spark.read.parquet(f"{path}/reads")
