import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, log, logs, plan, rows_of
from netsentry.operators import detect
from netsentry.plans import serving
from netsentry.schema import LOG_SCHEMA
from netsentry.session import STREAM_SETTINGS
from netsentry.sources import archive
from netsentry.sources.logs import encode_json, normalize, stream_messages
from netsentry.streaming import jobs

ONCE = {"availableNow": True}


def traffic():
    rows = [log(source_ip="a", action="BLOCKED", event_time=at(s), bytes_transferred=100) for s in range(0, 300, 7)]
    rows += [log(source_ip="b", user_agent="nmap", event_time=at(s), bytes_transferred=3_000_000) for s in range(0, 300, 2)]
    return rows


def publish(spark, rows, path):
    encode_json(logs(spark, rows)).coalesce(1).write.mode("append").json(path)


def finish(queries):
    for query in queries:
        query.awaitTermination(120)
        assert query.exception() is None


def open_stream(spark, path, max_files=None):
    return jobs.parse_stream(stream_messages(spark, path, max_files))


def test_alert_streams_equal_the_batch_result_on_closed_windows(spark, tmp_path):
    source, live, state = (str(tmp_path / n) for n in ("source", "live", "state"))
    publish(spark, traffic(), source)
    finish(jobs.start_alerts(open_stream(spark, source), live, state, ONCE, blocked_clock="event_time"))
    got = jobs.read_live(spark, live)

    batch = normalize(logs(spark, traffic()))
    newest = batch.agg(F.max("event_time")).first()[0]
    newest_blocked = batch.filter("action = 'blocked'").agg(F.max("event_time")).first()[0]
    def part(df, *types):
        return df.filter(F.col("alert_type").isin(*types))
    names = ("NMAP",)
    shape = ("source_ip", "alert_type", "count_value", "event_time")
    def expected(df):
        return rows_of(df.select(F.col("src_ip").alias("source_ip"), *shape[1:]))
    assert rows_of(part(got, *names).select(*shape)) == expected(detect.live_signature(batch))
    blocked = detect.live_repeated_blocked(batch).filter(F.col("event_time") <= F.lit(newest_blocked - timedelta(minutes=2)))
    assert rows_of(part(got, "REPEATED_BLOCKED_ACTIVITY").select(*shape)) == expected(blocked) != []
    volume = detect.live_volume(batch).filter(F.col("event_time") <= F.lit(newest - timedelta(seconds=30)))
    assert rows_of(part(got, "DATA_EXFILTRATION").select(*shape)) == expected(volume) != []


def test_restart_adds_only_new_alerts(spark, tmp_path):
    source, live, state = (str(tmp_path / n) for n in ("source", "live", "state"))
    publish(spark, [log(user_agent="nmap")] * 2, source)
    streams = lambda: jobs.alert_streams(open_stream(spark, source))["signature"]
    finish([jobs.start_alert("signature", streams(), live, state, ONCE)])
    finish([jobs.start_alert("signature", streams(), live, state, ONCE)])
    assert jobs.read_detector(spark, live, "signature").count() == 2
    publish(spark, [log(user_agent="nikto")], source)
    finish([jobs.start_alert("signature", streams(), live, state, ONCE)])
    got = jobs.read_detector(spark, live, "signature").collect()
    assert sorted(r["alert_type"] for r in got) == ["NIKTO", "NMAP", "NMAP"]
    assert all(r["inserted_at"] is not None and r["alert_date"] == r["inserted_at"].date() for r in got)


def test_old_event_times_do_not_hold_back_windows_on_arrival_time(spark, tmp_path):
    """The three detectors are separate queries: each has a watermark of its own."""
    source, live, state = (str(tmp_path / n) for n in ("source", "live", "state"))
    publish(spark, traffic(), source)
    queries = jobs.start_alerts(open_stream(spark, source), live, state, ONCE)
    assert len(queries) == 3
    finish(queries)
    watermarks = [q.lastProgress["eventTime"].get("watermark", "") for q in queries]
    assert watermarks[2].startswith("2026-01-05") and watermarks[1] > "2026-01-06"


def test_malformed_messages_do_not_stop_the_stream(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("source", "archive", "state"))
    publish(spark, [log(event_time=at(0)), log(event_time=None, timestamp="nan")], source)
    spark.createDataFrame([("k", "{broken")], "key string, value string").write.mode("append").json(source)
    finish([jobs.start_archive(open_stream(spark, source), table, state, files_per_batch=1, trigger=ONCE)])
    rows = archive.read_archive(spark, table).collect()
    assert len(rows) == 3 and sum(r["event_time"] is None for r in rows) == 2
    assert {r["year"] for r in rows} == {2026, None}


def test_archive_is_ready_for_the_batch_job(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("source", "archive", "state"))
    publish(spark, traffic()[:40], source)
    publish(spark, traffic()[40:], source)
    finish([jobs.start_archive(open_stream(spark, source, max_files=1), table, state, trigger=ONCE)])
    stored = archive.read_archive(spark, table)
    assert stored.count() == len(traffic())
    assert {r["action"] for r in stored.select("action").distinct().collect()} == {"blocked", "allowed"}
    # One archive stamp per micro-batch.
    assert stored.select("archived_at").distinct().count() == 2
    names = set(LOG_SCHEMA.fieldNames()) | {"event_time", "archived_at", "year", "month", "day", "hour"}
    assert set(stored.columns) == names
    types = {r["alert_type"] for r in detect.all_alerts(stored).collect()}
    assert types == {"NMAP", "REPEATED_BLOCKED_ACTIVITY", "DATA_EXFILTRATION"}


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    source, live, state = (str(tmp_path / n) for n in ("source", "live", "state"))
    big = dict(bytes_transferred=11 * 1024 * 1024)
    publish(spark, [log(event_time=at(0), **big), log(event_time=at(100))], source)
    time.sleep(1.1)  # file order is by modification time
    publish(spark, [log(event_time=at(101))], source)
    time.sleep(1.1)
    publish(spark, [log(event_time=at(5), **big), log(event_time=at(95), **big), log(event_time=at(200))], source)
    stream = jobs.alert_streams(open_stream(spark, source, max_files=1))["volume"]
    finish([jobs.start_alert("volume", stream, live, state, ONCE)])
    got = {r["event_time"]: r["count_value"] for r in jobs.read_detector(spark, live, "volume").collect()}
    # The row at 5 s came after its window had closed; the one at 95 s was within the delay.
    assert got == {at(10): 11 * 1024 * 1024, at(100): 11 * 1024 * 1024}


@pytest.mark.parametrize("name", jobs.DETECTORS)
def test_streams_have_the_live_schema(spark, tmp_path, name):
    publish(spark, [log()], str(tmp_path / "source"))
    stream = jobs.alert_streams(open_stream(spark, str(tmp_path / "source")))[name]
    assert stream.isStreaming and stream.columns == [
        "src_ip", "dest_ip", "protocol", "user_agent", "path", "alert_type", "count_value", "event_time",
    ]


def test_state_in_rocksdb_gives_the_same_alerts(spark, tmp_path):
    source = str(tmp_path / "source")
    publish(spark, traffic(), source)
    results = []
    for name, settings in (("plain", {}), ("rocks", STREAM_SETTINGS)):
        for key, value in settings.items():
            spark.conf.set(key, value)
        try:
            stream = jobs.alert_streams(open_stream(spark, source), "event_time")["repeated_blocked"]
            finish([jobs.start_alert("repeated_blocked", stream, str(tmp_path / name), str(tmp_path / f"state-{name}"), ONCE)])
        finally:
            for key in settings:
                spark.conf.unset(key)
        got = jobs.read_detector(spark, str(tmp_path / name), "repeated_blocked")
        results.append(rows_of(got.select("source_ip", "count_value", "event_time", "alert_id")))
    assert results[0] == results[1] != []


def test_reads_of_a_day_prune_the_stored_table(spark, tmp_path):
    source, live, state = (str(tmp_path / n) for n in ("source", "live", "state"))
    publish(spark, [log(user_agent="nmap")], source)
    stream = jobs.alert_streams(open_stream(spark, source))["signature"]
    finish([jobs.start_alert("signature", stream, live, state, ONCE)])
    table = jobs.read_detector(spark, live, "signature")
    day = table.first()["alert_date"]
    text = plan(serving.live_feed(table, day, 100, "10.9.0.1"))
    assert "alert_date" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert serving.live_feed(table, day, 100).count() == 1
    assert serving.live_feed(table, day - timedelta(days=1), 100).isEmpty()


def test_alert_job_keeps_its_state_in_rocksdb_and_leaves_the_session_alone(spark, tmp_path):
    source, live, state = (str(tmp_path / n) for n in ("source", "live", "state"))
    publish(spark, traffic(), source)
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    finish(jobs.start_alerts(open_stream(spark, source), live, state, ONCE, blocked_clock="event_time"))
    assert {key: spark.conf.get(key, None) for key in STREAM_SETTINGS} == before
    assert list((tmp_path / "state" / "volume" / "state").rglob("*.changelog")) or list((tmp_path / "state" / "volume" / "state").rglob("*.zip"))


def test_compaction_is_repeatable(spark, tmp_path):
    source, live, state, compact = (str(tmp_path / n) for n in ("source", "live", "state", "compact"))
    publish(spark, traffic(), source)
    finish(jobs.start_alerts(open_stream(spark, source), live, state, ONCE, blocked_clock="event_time"))
    for _ in range(2):
        jobs.compact_live(spark, live, compact)
        assert rows_of(jobs.read_compacted(spark, compact)) == rows_of(jobs.read_live(spark, live))
    assert len(list((tmp_path / "compact").rglob("*.parquet"))) == 1


def test_compacted_files_follow_the_size_also_within_one_source_and_instant(spark, tmp_path, monkeypatch):
    source, live, state, compact = (str(tmp_path / n) for n in ("source", "live", "state", "compact"))
    publish(spark, traffic(), source)
    finish(jobs.start_alerts(open_stream(spark, source), live, state, ONCE, blocked_clock="event_time"))
    rows = jobs.read_live(spark, live)
    hot = rows.filter("source_ip = 'b'").groupBy("inserted_at").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(jobs, "COMPACT_BYTES", 5_000, raising=False)
    jobs.compact_live(spark, live, compact)
    assert rows_of(jobs.read_compacted(spark, compact)) == rows_of(rows)
    sizes = [r["count"] for r in jobs.read_compacted(spark, compact).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 5 and max(sizes) <= 2 * sum(sizes) / len(sizes) < hot


def test_compaction_of_no_alerts(spark, tmp_path):
    source, live, state, compact = (str(tmp_path / n) for n in ("source", "live", "state", "compact"))
    publish(spark, traffic()[:1], source)
    finish(jobs.start_alerts(open_stream(spark, source), live, state, ONCE, blocked_clock="event_time"))
    jobs.compact_live(spark, live, compact)
    assert jobs.read_compacted(spark, compact).count() == jobs.read_live(spark, live).count() == 0
