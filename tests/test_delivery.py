"""Streams over several micro-batches and incremental views."""

from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helpers import START, at, log, logs, rows_of
from netsentry.operators import detect, live
from netsentry.plans import batch, store
from netsentry.plans.delivery import reconciled
from netsentry.plans.incremental import files_read, refresh_incremental
from netsentry.plans.views import VIEW_KEYS
from netsentry.sources import archive
from netsentry.sources import logs as L
from netsentry.streaming import jobs

DRAIN = {"availableNow": True}


def messages(spark, path, batches):
    """Sends rows (position, seconds) in batches and gives the stream of them, a batch at a time."""
    rows = [(*log(source_ip="a", user_agent="nmap", event_time=at(s)), p, k) for k, b in enumerate(batches) for p, s in b]
    frame = spark.createDataFrame(rows, logs(spark, []).schema.add("position", "long").add("batch", "long"))
    L.deliver(L.encode_json(frame, "position", ("batch",)), "batch", range(len(batches)), path)
    return jobs.parse_stream(L.stream_messages(spark, path, 1, True), ("position",))


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_late_and_repeated_messages(spark, tmp_path):
    base = str(tmp_path)
    # 30 s behind the newest of the batches up to the second last: batch 2 drops up to 70 s, batch 3 up to 170 s.
    batches = [[(1, 0), (2, 100)], [(3, 50), (4, 200), (2, 100)], [(5, 70), (6, 71), (4, 200)], [(7, 170), (8, 171), (9, 300)], [(9, 300)]]
    once = jobs.once_each(messages(spark, f"{base}/s", batches))
    query = run(jobs.start_batches(once.select("position"), f"{base}/out", f"{base}/c", DRAIN))
    assert sorted(r.position for r in jobs.read_batches(spark, f"{base}/out").collect()) == [1, 2, 3, 4, 6, 8, 9]
    found = {p["batch"]: (p["rows"], p["late_rows"], p["again"]) for p in jobs.batch_progress(query)}
    assert found == {0: (2, 0, 0), 1: (3, 0, 1), 2: (3, 1, 1), 3: (3, 1, 0), 4: (1, 0, 1)}


def test_a_window_closes_once_over_several_batches(spark, tmp_path):
    base = str(tmp_path)
    batches = [[(1, 1), (2, 2)], [(3, 3), (4, 15)], [(5, 100)], [(7, 101)], [(6, 4), (8, 200)]]
    volume = detect.live_volume(jobs.once_each(messages(spark, f"{base}/s", batches)), threshold=0)
    run(jobs.start_alert("volume", volume, f"{base}/live", f"{base}/c", DRAIN))
    got = jobs.read_detector(spark, f"{base}/live", "volume").select("event_time", "count_value")
    # Message 6 comes after the watermark has passed its window; the last window stays open.
    assert rows_of(got) == [(at(10), 300), (at(20), 100), (at(110), 200)]


def test_repeated_batches_leave_one_copy(spark, tmp_path):
    base = str(tmp_path)
    stream = messages(spark, f"{base}/s", [[(1, 0)], [(2, 1), (3, 2)], [(4, 3)]])
    failures = [1, 1, 2]

    def fail(number):
        if failures and failures[0] == number:
            failures.pop(0)
            raise RuntimeError("before the commit")

    runs = 0
    while True:
        runs += 1
        query = jobs.start_batches(stream.select("position"), f"{base}/out", f"{base}/c", DRAIN, fail)
        try:
            query.awaitTermination(120)
            break
        except StreamingQueryException:
            pass
    assert runs == 4 and not failures
    assert rows_of(jobs.read_batches(spark, f"{base}/out").select("position", "batch")) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_equal_events_are_two_alerts_only_with_their_position(spark):
    rows = [(*log(user_agent="nmap"), p) for p in (1, 2, 2)]
    frame = spark.createDataFrame(rows, logs(spark, []).schema.add("position", "long"))
    ids = lambda **kw: [r.alert_id for r in live.stored(detect.live_signature(frame, **kw), **({"message": ("position",)} if kw else {})).collect()]
    assert len(set(ids())) == 1 and len(set(ids(keep=("position",)))) == 2


def test_stop_and_restart_lose_and_double_nothing(spark, tmp_path):
    base = str(tmp_path)
    stream = messages(spark, f"{base}/s", [[(10 * b + k, b) for k in range(5)] for b in range(6)])
    start = lambda trigger: jobs.start_archive(stream, f"{base}/a", f"{base}/c", trigger=trigger)
    jobs.stop_after(start({"processingTime": "0 seconds"}), 2)
    run(start(DRAIN))
    due = spark.createDataFrame([(10 * b + k,) for b in range(6) for k in range(5)], "id bigint")
    got = archive.read_archive(spark, f"{base}/a").select(F.col("position").alias("id"))
    assert tuple(reconciled(due, got).first()) == (30, 30, 0, 0, 0)


def test_reconciled_counts(spark):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert tuple(reconciled(frame([1, 1, 2, 3]), frame([1, 2, 2, 2, 9])).first()) == (4, 5, 2, 1, 2)
    assert tuple(reconciled(frame([]), frame([])).first()) == (0, 0, 0, 0, 0)


def test_reasons_of_rejected_messages(spark):
    values = {
        None: L.EMPTY, "": L.EMPTY, " \t": L.EMPTY, "{": L.MALFORMED, "text": L.MALFORMED, "[1]": L.MALFORMED, "7": L.MALFORMED,
        '{"a": 1}': L.FOREIGN, "{}": L.FOREIGN, '{"source_ip": "1", "bytes_transferred": "x"}': L.MISTYPED,
    }
    good = ['{"source_ip": "1"}', '{"source_ip": "1", "bytes_transferred": 3, "other": [1]}']
    rows = spark.createDataFrame([(v,) for v in [*values, *good]], "value string")
    assert {r.value: r.reason for r in L.rejected(rows).collect()} == values


def dense(k, start, seconds):
    """Blocked traffic of two sources, some volume and some signatures, in a stretch of time."""
    rows = [log(source_ip=f"b{k % 2}", action="BLOCKED", event_time=at(s), archived_at=at(s)) for s in range(start, start + seconds, 4)]
    rows += [log(source_ip="v", bytes_transferred=900_000, event_time=at(s), archived_at=at(s)) for s in range(start, start + seconds, 5)]
    return rows + [log(source_ip="n", user_agent="nmap", dest_ip=f"t{s % 3}", event_time=at(s), archived_at=at(s)) for s in range(start, start + seconds, 30)]


def test_incremental_refresh_equals_full_refresh(spark, tmp_path):
    base = str(tmp_path)
    # Two stretches meet within a window; the third delivery has late events of the first stretch, the fourth nothing new.
    deliveries = [dense(0, 0, 103), dense(0, 103, 400), dense(1, 20, 30) + dense(0, 503, 100)]
    versions, everything = [], []
    for rows in deliveries:
        archive.write_archive(L.prepare(logs(spark, rows)), f"{base}/archive", files_per_write=1)
        everything += rows
        versions.append(refresh_incremental(spark, f"{base}/archive", f"{base}/inc", max_files=1))
    assert refresh_incremental(spark, f"{base}/archive", f"{base}/inc") == versions[-1]
    assert versions == sorted(set(versions))
    batch.refresh_views(L.prepare(logs(spark, everything)), f"{base}/full")
    for name in VIEW_KEYS:
        assert rows_of(store.read_view(spark, f"{base}/inc", name)) == rows_of(store.read_view(spark, f"{base}/full", name)), name
    windows = spark.read.parquet(f"{base}/inc/windows/version={versions[-1]}")
    assert windows.count() > 60
    read = files_read(spark, f"{base}/inc")
    assert read.agg(F.sum("logs")).first()[0] == len(everything) and read.count() == read.select("file").distinct().count()


@pytest.mark.parametrize("offset, rows", [(0, 5), (990, 20), (500, 300), (1200, 5), (1500, 5)])
def test_deep_slice_equals_a_plain_one(spark, offset, rows):
    table = spark.range(1000).select((F.col("id") * F.col("id")).alias("key"), F.timestamp_seconds(F.col("id") * 7).alias("at"))
    table = table.unionByName(spark.range(200).select(F.lit(-5).cast("bigint").alias("key"), F.lit(START - timedelta(days=9999)).alias("at")))
    for column in ("key", "at"):
        keys = sorted(r[0] for r in table.select(column).collect())
        got = [r[0] for r in L.deep_slice(table.select(column), column, offset, rows, bins=7, most=10).collect()]
        assert got == keys[offset : offset + rows]


def test_deep_slice_with_nulls_and_none(spark):
    table = spark.range(100).select(F.when(F.col("id") >= 10, F.col("id")).alias("key"))
    assert [r.key for r in L.deep_slice(table, "key", 8, 4, bins=3, most=1).collect()] == [None, None, 10, 11]
    assert [r.key for r in L.deep_slice(table, "key", 60, 2, bins=3, most=1).collect()] == [60, 61]
    assert L.deep_slice(table.limit(0), "key", 0, 2).count() == 0
    with pytest.raises(TypeError):
        L.deep_slice(table.select(F.col("key").cast("string")), "key", 0, 1)
