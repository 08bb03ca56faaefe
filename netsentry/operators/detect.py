"""The detectors: normalized logs in, alerts out.

Batch alerts carry `BATCH_ALERT_SCHEMA`, live alerts `LIVE_ALERT_SCHEMA`.
Every detector is a pure DataFrame expression; those marked live also run on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsentry.functions.match import signature_type
from netsentry.rules import (
    BLOCKED_SLIDE_SECONDS,
    BLOCKED_WINDOW_SECONDS,
    NO_VALUE,
    REPEATED_BLOCKED,
    REPEATED_BLOCKED_MIN_EVENTS,
    REPEATED_BLOCKED_PATH,
    VOLUME,
    VOLUME_MIN_BYTES,
    VOLUME_PATH,
    VOLUME_WINDOW_SECONDS,
)
from netsentry.schema import BATCH_ALERT_SCHEMA, LIVE_ALERT_SCHEMA


def _matched(logs: DataFrame) -> DataFrame:
    """Events on which a rule fires, with `alert_type`.

    The alert type is produced by a generator over a one-element array. A plain column would be copied into the
    filter below the projection and the 36 tests would run twice, each lowercasing its text again; here each
    event is lowercased once and classified once, inside one code-generation stage.
    """
    lowered = logs.withColumns({"_agent": F.lower("user_agent"), "_path": F.lower("request_path")})
    typed = lowered.select(
        "*", F.explode(F.array(signature_type(F.col("_agent"), F.col("_path")))).alias("alert_type")
    )
    return typed.filter(F.col("alert_type").isNotNull()).drop("_agent", "_path")


def _shaped(df: DataFrame, schema, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in schema.fields], *keep)


def signature(logs: DataFrame) -> DataFrame:
    """At most one alert per event, by the first signature that matches. Row-wise: no shuffle."""
    return _shaped(
        _matched(logs),
        BATCH_ALERT_SCHEMA,
        src_ip=F.col("source_ip"),
        dest_ip=F.col("dest_ip"),
        protocol=F.col("protocol"),
        path=F.col("request_path"),
        alert_type=F.col("alert_type"),
        event_time=F.col("event_time"),
        archived_at=F.col("archived_at"),
        bytes_transferred=F.col("bytes_transferred"),
        threat_label=F.col("threat_label"),
        action=F.col("action"),
    )


# The panes of a source are brought together per stretch of this many windows, see `_full_windows`.
STRETCH_WINDOWS = 10


def _activity_alert(df: DataFrame, alert_type: str, path: str, threat_label: str, action: str) -> DataFrame:
    return _shaped(
        df,
        BATCH_ALERT_SCHEMA,
        src_ip=F.col("source_ip"),
        dest_ip=F.lit(NO_VALUE),
        protocol=F.col("protocol"),
        path=F.lit(path),
        alert_type=F.lit(alert_type),
        event_time=F.col("event_time"),
        archived_at=F.col("archived_at"),
        bytes_transferred=F.col("bytes"),
        threat_label=F.lit(threat_label),
        action=F.lit(action),
    )


def _event_totals() -> list[Column]:
    return [
        F.count("*").alias("events"),
        F.sum("bytes_transferred").alias("bytes"),
        F.max("event_time").alias("event_time"),
        F.max("archived_at").alias("archived_at"),
    ]


def _totals() -> list[Column]:
    return [
        F.sum("events").alias("events"),
        F.sum("bytes").alias("bytes"),
        F.max("event_time").alias("event_time"),
        F.max("archived_at").alias("archived_at"),
    ]


def _panes(logs: DataFrame, time: Column, slide: int) -> DataFrame:
    """Events summed per source, protocol and pane, a pane being as long as the slide; null times form a pane too."""
    seconds = F.unix_seconds(time)
    return (
        logs.withColumn("pane", seconds - F.pmod(seconds, F.lit(slide)))
        .groupBy("source_ip", "protocol", "pane")
        .agg(*_event_totals())
    )


def _full_windows(panes: DataFrame, size: int, slide: int, threshold: int) -> DataFrame:
    """Sliding windows with at least `threshold` events, summed from panes.

    A pane counts towards every window that contains it. Instead of shuffling a copy of it per window, time is cut
    into stretches of ten windows, a window belonging to the stretch it starts in: only a pane near the start of a
    stretch is needed in two of them. Panes are shuffled by stretch, and the copies per window are made and summed
    where they land. A stretch of one source holds few panes, however many events they stand for; one with too few
    events in all has no full window and is dropped before the copies are made.
    """
    reach = F.lit(size - slide)
    length = size * STRETCH_WINDOWS

    def stretch_of(second: Column) -> Column:
        return second - F.pmod(second, F.lit(length))

    in_stretches = panes.withColumn(
        "stretch",
        F.explode_outer(F.array_distinct(F.array(stretch_of(F.col("pane") - reach), stretch_of(F.col("pane"))))),
    )
    first = F.greatest(F.col("pane") - reach, F.col("stretch"))
    last = F.least(F.col("pane"), F.col("stretch") + F.lit(length - slide))
    together = Window.partitionBy("source_ip", "protocol", "stretch")
    return (
        in_stretches.repartition("source_ip", "protocol", "stretch")
        .withColumn("in_stretch", F.sum("events").over(together))
        .filter(F.col("in_stretch") >= threshold)
        .withColumn("window_start", F.explode(F.sequence(first, last, F.lit(slide).cast("long"))))
        .groupBy("source_ip", "protocol", "stretch", "window_start")
        .agg(*_totals())
        .filter(F.col("events") >= threshold)
    )


def _blocked_alert(windows: DataFrame) -> DataFrame:
    return _activity_alert(windows, REPEATED_BLOCKED, REPEATED_BLOCKED_PATH, "suspicious", "blocked")


def _volume_alert(totals: DataFrame) -> DataFrame:
    return _activity_alert(totals, VOLUME, VOLUME_PATH, "malicious", "allowed")


def _check_panes(size: int, slide: int) -> None:
    if slide <= 0 or size % slide:
        raise ValueError(f"the slide ({slide} s) must divide the window ({size} s)")


def repeated_blocked(
    logs: DataFrame,
    time_col: str = "archived_at",
    size: int = BLOCKED_WINDOW_SECONDS,
    slide: int = BLOCKED_SLIDE_SECONDS,
    threshold: int = REPEATED_BLOCKED_MIN_EVENTS,
) -> DataFrame:
    """Blocked events per source and protocol in sliding windows; one alert for each window that is full enough.

    Events are first summed into panes as long as the slide. Count, sum and maximum combine exactly, so this equals
    windowing every event. A source with a third of the traffic becomes a few partial rows per task before the
    shuffle.
    """
    _check_panes(size, slide)
    blocked = logs.filter((F.col("action") == "blocked") & F.col(time_col).isNotNull())
    return _blocked_alert(_full_windows(_panes(blocked, F.col(time_col), slide), size, slide, threshold))


def volume_total(logs: DataFrame, threshold: int = VOLUME_MIN_BYTES) -> DataFrame:
    """Bytes per source and protocol over all given logs; an alert where the sum passes the threshold."""
    totals = logs.groupBy("source_ip", "protocol").agg(*_event_totals())
    return _volume_alert(totals.filter(F.col("bytes") > threshold))


def activity(
    logs: DataFrame,
    time_col: str = "archived_at",
    size: int = BLOCKED_WINDOW_SECONDS,
    slide: int = BLOCKED_SLIDE_SECONDS,
    min_events: int = REPEATED_BLOCKED_MIN_EVENTS,
    min_bytes: int = VOLUME_MIN_BYTES,
) -> DataFrame:
    """`repeated_blocked` and `volume_total` together from one scan of the logs.

    Blocked events are summed per pane and everything else under a null pane, so unblocked traffic shrinks to one
    row per source and protocol before the first shuffle. Both detectors go on from these sums: they ask for the
    same columns and filter nothing before, so Spark shuffles the panes once and reads that shuffle twice.
    """
    _check_panes(size, slide)
    panes = activity_panes(logs, time_col, slide)
    return _blocked_alert(blocked_windows(panes, size, slide, min_events)).unionByName(volume_from_panes(panes, min_bytes))


def activity_panes(logs: DataFrame, time_col: str = "archived_at", slide: int = BLOCKED_SLIDE_SECONDS) -> DataFrame:
    """Events, bytes and last times per source, protocol and pane of blocked events; all other traffic in a null pane."""
    return _panes(logs, F.when(F.col("action") == "blocked", F.col(time_col)), slide)


def merged_panes(panes: DataFrame) -> DataFrame:
    """Panes of several parts of the logs as those of all of them."""
    return panes.groupBy("source_ip", "protocol", "pane").agg(*_totals())


def blocked_windows(
    panes: DataFrame,
    size: int = BLOCKED_WINDOW_SECONDS,
    slide: int = BLOCKED_SLIDE_SECONDS,
    threshold: int = REPEATED_BLOCKED_MIN_EVENTS,
) -> DataFrame:
    """The windows with enough blocked events, with `window_start` in seconds and their sums."""
    return _full_windows(panes, size, slide, threshold).filter(F.col("window_start").isNotNull())


def blocked_from_windows(windows: DataFrame) -> DataFrame:
    return _blocked_alert(windows)


def volume_from_panes(panes: DataFrame, threshold: int = VOLUME_MIN_BYTES) -> DataFrame:
    totals = panes.groupBy("source_ip", "protocol").agg(*_totals())
    return _volume_alert(totals.filter((F.col("bytes") > threshold) & (F.col("events") > 0)))


def all_alerts(logs: DataFrame) -> DataFrame:
    """Bag union of the three detectors: two scans of the logs, each pruned to the columns it needs."""
    return signature(logs).unionByName(activity(logs))


def live_signature(logs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Live form of `signature`, for batch and stream, with the log's columns `keep` behind. Stateless."""
    return _shaped(
        _matched(logs),
        LIVE_ALERT_SCHEMA,
        keep,
        src_ip=F.col("source_ip"),
        dest_ip=F.col("dest_ip"),
        protocol=F.col("protocol"),
        user_agent=F.col("user_agent"),
        path=F.col("request_path"),
        alert_type=F.col("alert_type"),
        count_value=F.lit(None),
        event_time=F.col("event_time"),
    )


def _live_window_alert(df: DataFrame, alert_type: str, path: str) -> DataFrame:
    return _shaped(
        df,
        LIVE_ALERT_SCHEMA,
        src_ip=F.col("source_ip"),
        dest_ip=F.lit(NO_VALUE),
        protocol=F.col("protocol"),
        user_agent=F.lit(NO_VALUE),
        path=F.lit(path),
        alert_type=F.lit(alert_type),
        count_value=F.col("measure"),
        event_time=F.col("window.end"),
    )


def _watermarked(logs: DataFrame, time_col: str, watermark: str | None) -> DataFrame:
    return logs if watermark is None else logs.withWatermark(time_col, watermark)


def live_repeated_blocked(
    logs: DataFrame,
    time_col: str = "event_time",
    size: int = BLOCKED_WINDOW_SECONDS,
    slide: int = BLOCKED_SLIDE_SECONDS,
    threshold: int = REPEATED_BLOCKED_MIN_EVENTS,
    watermark: str | None = None,
) -> DataFrame:
    """Live form of `repeated_blocked`, for batch and stream; the alert is timed at the end of its window.

    `time_col` decides the clock: the event's own time, or the arrival time the job stamps on each micro-batch. In batch
    the windows are summed from panes as in `repeated_blocked`; a stream keeps a sum per window, which closes with it.
    """
    blocked = logs.filter(F.col("action") == "blocked")
    if not logs.isStreaming and size % slide == 0:
        panes = _panes(blocked.filter(F.col(time_col).isNotNull()), F.col(time_col), slide)
        full = _full_windows(panes, size, slide, threshold)
        end = F.timestamp_seconds(F.col("window_start") + size)
        return _live_window_alert(
            full.select("source_ip", "protocol", F.col("events").alias("measure"), F.struct(end.alias("end")).alias("window")),
            REPEATED_BLOCKED, REPEATED_BLOCKED_PATH,
        )
    windows = (
        _watermarked(blocked, time_col, watermark)
        .groupBy(F.window(time_col, f"{size} seconds", f"{slide} seconds"), "source_ip", "protocol")
        .agg(F.count("*").alias("measure"))
        .filter(F.col("measure") >= threshold)
    )
    return _live_window_alert(windows, REPEATED_BLOCKED, REPEATED_BLOCKED_PATH)


def live_volume(
    logs: DataFrame,
    time_col: str = "event_time",
    size: int = VOLUME_WINDOW_SECONDS,
    threshold: int = VOLUME_MIN_BYTES,
    watermark: str | None = None,
) -> DataFrame:
    """Bytes per source and protocol in tumbling windows, for batch and stream; timed at the end of the window."""
    windows = (
        _watermarked(logs, time_col, watermark)
        .groupBy(F.window(time_col, f"{size} seconds"), "source_ip", "protocol")
        .agg(F.sum("bytes_transferred").alias("measure"))
        .filter(F.col("measure") > threshold)
    )
    return _live_window_alert(windows, VOLUME, VOLUME_PATH)
