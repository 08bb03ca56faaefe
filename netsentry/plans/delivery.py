"""Queries of the streaming jobs over several micro-batches: late and repeated messages, failures, restarts, quarantine."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsentry.operators import detect, live
from netsentry.plans import store
from netsentry.plans.incremental import files_read, refresh_incremental
from netsentry.session import work_dir
from netsentry.sources import archive, logs
from netsentry.streaming import jobs

# Parameters of the queries.
BATCHES = 8  # micro-batches that the log arrives in
LATE_EVERY, LATE_BY = 13, 2  # one message in so many arrives so many batches late
AGAIN_EVERY = 29  # one message in so many is sent again in the next batch
TWIN_EVERY = 11  # one event in so many happens twice
VOLUME_BYTES = 400_000  # live byte threshold, low enough for the data at hand
STREAM_SECONDS = 3_600  # a stream over the whole table that takes longer has hung
DRAIN = {"availableNow": True}


def finish(query: StreamingQuery) -> None:
    if not query.awaitTermination(STREAM_SECONDS):
        query.stop()
        raise TimeoutError(f"the stream {query.name} has not ended")
    if query.exception() is not None:
        raise query.exception()


def _every(number: int) -> Column:
    return F.col("event_id") % number == 0


def _twins(rows: DataFrame) -> DataFrame:
    """The log in which some events happen twice: the second one is equal but for its position, event_id + 1 of twice."""
    copies = F.when(_every(TWIN_EVERY), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).withColumn("position", F.col("event_id") * 2 + F.col("copy"))


def _sent(rows: DataFrame) -> DataFrame:
    """The messages with the `batch` they are sent in: late ones in a later batch, repeated ones in two."""
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    low, high = low or 0, high or 0
    share = F.expr(f"(event_id - {low}) * {BATCHES} div {high - low + 1}")
    first = F.least(F.when(_every(LATE_EVERY), share + LATE_BY).otherwise(share), F.lit(BATCHES - 1))
    again = F.when(_every(AGAIN_EVERY), F.least(first + 1, F.lit(BATCHES - 1)))
    return rows.withColumn("batch", F.explode(F.array_compact(F.array(first, again))))


def _source(i, rows: DataFrame, base: str, batches: range = range(BATCHES)) -> DataFrame:
    """The stream of the messages, one batch at a time."""
    logs.deliver(logs.encode_json(rows, "position", ("batch",)), "batch", batches, f"{base}/source")
    return logs.stream_messages(i.spark, f"{base}/source", max_files=1, position=True)


def _read(messages: DataFrame) -> DataFrame:
    return jobs.parse_stream(messages, ("position",))


def _late_job(i, base: str) -> StreamingQuery:
    """Volume alerts of the log that arrives late and repeated, each message once."""
    rows = _sent(i.raw_logs().withColumn("position", F.col("event_id")))
    once = jobs.once_each(_read(_source(i, rows, base)))
    query = jobs.start_alert("volume", detect.live_volume(once, threshold=VOLUME_BYTES), f"{base}/live", f"{base}/checkpoint", DRAIN)
    finish(query)
    return query


def stream_late_rows(i) -> DataFrame:
    """Of each micro-batch: its messages, and how many the watermark dropped as late, by the state operators' count."""
    found = jobs.batch_progress(_late_job(i, work_dir(i.spark, "late")))
    return i.spark.createDataFrame([(p["batch"], p["rows"], p["late_rows"]) for p in found], "batch bigint, messages bigint, late_rows bigint")


def stream_late_windows(i) -> DataFrame:
    """The volume windows that the moving watermark closed, once each, without late rows and with repeated ones once."""
    base = work_dir(i.spark, "late")
    _late_job(i, base)
    alerts = jobs.read_detector(i.spark, f"{base}/live", "volume")
    return alerts.select(F.col("source_ip").alias("src_ip"), "protocol", "count_value", "event_time")


def _signatures(messages: DataFrame) -> DataFrame:
    """Signature alerts of a message stream in their stored form, told apart by the position of their message."""
    return live.stored(detect.live_signature(_read(messages), keep=("position",)), message=("position",))


def stream_dual_delivery(i) -> DataFrame:
    """Archive and signature alerts from one source of messages, both stopped after some micro-batches and started again
    from their checkpoints, then held against what was sent: per job the rows that are due, those delivered, lost (due,
    not delivered), strange (delivered, not due) and doubled."""
    base = work_dir(i.spark, "dual")
    rows = i.raw_logs().withColumn("position", F.col("event_id"))
    rows = _sent(rows).groupBy(*rows.columns).agg(F.min("batch").alias("batch"))  # each message once
    messages = _source(i, rows, base)

    def archive_job(trigger: dict) -> StreamingQuery:
        return jobs.start_archive(_read(messages), f"{base}/archive", f"{base}/archive-checkpoint", trigger=trigger)

    def alert_job(trigger: dict) -> StreamingQuery:
        return jobs.start_batches(_signatures(messages), f"{base}/alerts", f"{base}/alert-checkpoint", trigger)

    first = [archive_job({"processingTime": "0 seconds"}), alert_job({"processingTime": "0 seconds"})]
    for query in first:
        jobs.stop_after(query, 2)
    again = [archive_job(DRAIN), alert_job(DRAIN)]
    for query in again:
        finish(query)

    due = logs.normalize(logs.with_event_time(rows))
    due_alerts = live.stored(detect.live_signature(due, keep=("position",)), message=("position",))
    pairs = {
        "archive": (due.select(F.col("position").alias("id")), archive.read_archive(i.spark, f"{base}/archive").select(F.col("position").alias("id"))),
        "alerts": (due_alerts.select(F.col("alert_id").alias("id")), jobs.read_batches(i.spark, f"{base}/alerts").select(F.col("alert_id").alias("id"))),
    }
    result = None
    for name, (wanted, got) in pairs.items():
        counts = reconciled(wanted, got).select(F.lit(name).alias("job"), "*")
        result = counts if result is None else result.unionByName(counts)
    return result


def reconciled(due: DataFrame, delivered: DataFrame, key: str = "id") -> DataFrame:
    """One row: `due`, `delivered`, `lost` (anti join), `strange` (anti join the other way) and `doubled`, the rows too
    many of a key that came more than once. Keys are summed before they meet, so a key that came very often is one row."""
    wanted = due.groupBy(key).agg(F.count(F.lit(1)).alias("due"))
    got = delivered.groupBy(key).agg(F.count(F.lit(1)).alias("delivered"))
    met = wanted.join(got, key, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.agg(
        F.coalesce(F.sum("due"), F.lit(0)).alias("due"),
        F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered"),
        F.coalesce(F.sum(F.greatest(zero("due") - zero("delivered"), F.lit(0))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.when(F.col("due").isNull(), F.col("delivered"))), F.lit(0)).alias("strange"),
        F.coalesce(F.sum(F.when(F.col("due") < F.col("delivered"), F.col("delivered") - F.col("due"))), F.lit(0)).alias("doubled"),
    )


class Failure(Exception):
    """Raised on purpose between a write and its commit."""


def stream_retry(i) -> DataFrame:
    """Signature alerts per type from a sink that fails twice after its write and before the commit, so that two
    micro-batches are written again; the result is that of a clean run."""
    base = work_dir(i.spark, "retry")
    messages = _source(i, _sent(i.raw_logs().withColumn("position", F.col("event_id"))).filter(~_every(AGAIN_EVERY)), base)
    failing = [1, BATCHES - 2]

    def fail(number: int) -> None:
        if failing and number == failing[0]:
            failing.pop(0)
            raise Failure(f"after the write of micro-batch {number}")

    while True:
        query = jobs.start_batches(_signatures(messages), f"{base}/alerts", f"{base}/checkpoint", DRAIN, fail)
        try:
            finish(query)
            break
        except StreamingQueryException as error:
            if "after the write of micro-batch" not in str(error):
                raise
    alerts = jobs.read_batches(i.spark, f"{base}/alerts")
    return alerts.groupBy("alert_type").agg(F.count("*").alias("alerts"), F.count_distinct("alert_id").alias("ids"))


def stream_alert_identity(i) -> DataFrame:
    """Signature alerts per type where some events happen twice and some messages are sent twice: equal events of two
    messages are two alerts, a message that comes again is none."""
    base = work_dir(i.spark, "identity")
    rows = _sent(_twins(i.raw_logs()))
    once = jobs.once_each(_read(_source(i, rows, base)), delay="3650 days")
    alerts = live.stored(detect.live_signature(once, keep=("position",)), message=("position",))
    finish(jobs.start_batches(alerts, f"{base}/alerts", f"{base}/checkpoint", DRAIN))
    found = jobs.read_batches(i.spark, f"{base}/alerts")
    return found.groupBy("alert_type").agg(F.count("*").alias("alerts"), F.count_distinct("alert_id").alias("ids"))


def _spoiled(i) -> DataFrame:
    """Messages of the log, some of which cannot be read: by turns cut off, empty, of another form, with a wrong type."""
    keyed = logs.encode_json(i.raw_logs(), "event_id").withColumn("turn", F.col("position") % 23)
    value = (
        F.when(F.col("turn") == 0, F.expr("left(value, 10)"))
        .when(F.col("turn") == 1, F.lit(" "))
        .when(F.col("turn") == 2, F.lit(None).cast("string"))
        .when(F.col("turn") == 3, F.lit('{"other": 1}'))
        .when(F.col("turn") == 4, F.regexp_replace("value", '"bytes_transferred":[0-9]+', '"bytes_transferred":"many"'))
        .when(F.col("turn") == 5, F.lit("[1, 2]"))
        .otherwise(F.col("value"))
    )
    return keyed.withColumn("value", value).drop("turn")


def rejected_messages(i) -> DataFrame:
    """The messages that cannot be read, with the reason, as the batch reader and as the stream's quarantine have them."""
    base = work_dir(i.spark, "quarantine")
    messages = _spoiled(i)
    by_batch = logs.rejected(messages, keep=("position",))
    messages.write.option("ignoreNullFields", "false").json(f"{base}/source")
    stream = logs.stream_messages(i.spark, f"{base}/source", position=True)
    finish(jobs.start_quarantine(stream, f"{base}/rejected", f"{base}/checkpoint", DRAIN, keep=("position",)))
    by_stream = i.spark.read.parquet(f"{base}/rejected")
    columns = ["position", "reason", F.length("value").cast("bigint").alias("length")]
    return by_batch.select(F.lit("batch").alias("reader"), *columns).unionByName(by_stream.select(F.lit("stream").alias("reader"), *columns))


ARCHIVE_PARTS = 3  # deliveries of the archive, each followed by a refresh


def _refreshed(i, path: str) -> None:
    """The archive written in deliveries, some of its events a delivery late, and the views refreshed after each."""
    rows = logs.prepare(i.raw_logs())
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    low, high = low or 0, high or 0
    share = F.expr(f"(event_id - {low}) * {ARCHIVE_PARTS} div {high - low + 1}")
    part = F.least(F.when(_every(LATE_EVERY), share + 1).otherwise(share), F.lit(ARCHIVE_PARTS - 1))
    for number in range(ARCHIVE_PARTS):
        archive.write_archive(rows.filter(part == number), f"{path}/archive", files_per_write=1)
        refresh_incremental(i.spark, f"{path}/archive", f"{path}/views")


def views_incremental(i) -> DataFrame:
    """The reputation after three incremental refreshes, from the view store."""
    path = work_dir(i.spark, "incremental")
    _refreshed(i, path)
    return store.read_view(i.spark, f"{path}/views", "ip_reputation").drop("row_key")


def incremental_reads(i) -> DataFrame:
    """What each of the three refreshes has read of the archive: its new files only."""
    path = work_dir(i.spark, "incremental")
    _refreshed(i, path)
    read = files_read(i.spark, f"{path}/views").groupBy(F.col("part").cast("bigint").alias("refresh"))
    return read.agg(F.count_distinct("file").alias("files"), F.sum("logs").alias("logs"))


QUERIES = {
    "views_incremental": views_incremental,
    "incremental_reads": incremental_reads,
    "stream_late_rows": stream_late_rows,
    "stream_late_windows": stream_late_windows,
    "stream_dual_delivery": stream_dual_delivery,
    "stream_retry": stream_retry,
    "stream_alert_identity": stream_alert_identity,
    "rejected_messages": rejected_messages,
}
