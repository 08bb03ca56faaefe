import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import at, log, logs, plan, rows_of
from netsentry.functions.text import number_or_zero, row_key, text_cell, whole_or_zero
from netsentry.operators import detect
from netsentry.schema import LOG_SCHEMA
from netsentry.session import work_dir
from netsentry.sources import archive, logs as src
from netsentry.sources.netlog import netlog

CSV = os.path.join(os.path.dirname(__file__), "data", "logs.csv")


def test_csv_to_alerts(spark):
    raw = src.read_log_csv(spark, CSV)
    assert raw.schema.fieldNames() == LOG_SCHEMA.fieldNames() and raw.count() == 10
    prepared = src.normalize(src.with_event_time(raw)).withColumn("archived_at", F.col("event_time"))
    types = [r["alert_type"] for r in detect.signature(prepared).collect()]
    assert sorted(types) == ["ENV_FILE_ACCESS", "NMAP", "SQLMAP", "WP_LOGIN"]
    blocked = detect.repeated_blocked(prepared).collect()
    # Events at :05, :06, :09, :12 and :13 share the windows that start from 8:59:20 to 9:00:00.
    assert len(blocked) == 5 and {(r["src_ip"], r["protocol"]) for r in blocked} == {("203.0.113.10", "HTTP")}


HEADER = "timestamp,source_ip,dest_ip,protocol,action,threat_label,log_type,bytes_transferred,user_agent,request_path"


def test_csv_keeps_quoted_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '\n2026,a,b,HTTP,allowed,clean,ids,7,"x, y","/q?a=""><script>,b\\""c"\n')
    row = src.read_log_csv(spark, str(tmp_path)).first()
    assert row["request_path"] == '/q?a="><script>,b\\"c' and row["user_agent"] == "x, y" and row["bytes_transferred"] == 7


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '\n2026,a,b,HTTP,allowed,clean,ids,7,"x\ny",/\n2027,c,d,TCP,allowed,clean,ids,,z,/\n')
    rows = src.read_log_csv(spark, str(tmp_path), multi_line=True).collect()
    assert [(r["source_ip"], r["user_agent"], r["bytes_transferred"]) for r in rows] == [("a", "x\ny", 7), ("c", "z", None)]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("extra,dest_ip,source_ip,bytes_transferred\n1,target,origin,no number\n")
    frame = src.read_log_csv(spark, str(tmp_path))
    assert frame.schema.fieldNames() == LOG_SCHEMA.fieldNames()
    row = frame.first()
    assert (row["source_ip"], row["dest_ip"], row["bytes_transferred"], row["user_agent"]) == ("origin", "target", None, None)


def test_rejects(spark):
    rows = [('{"source_ip": "a"}',), ("{",), (None,), ("[]",), ('{"bytes_transferred": 3}',), ('{"other": 1}',)]
    got = src.rejects(spark.createDataFrame(rows, "value string")).first()
    assert (got["messages"], got["rejected"]) == (6, 4)


def test_json_roundtrip_and_malformed_messages(spark):
    df = logs(spark, [log(dest_ip=None), log(bytes_transferred=7)])
    messages = src.encode_json(df)
    assert {r["key"] for r in messages.collect()} == {"10.9.0.1"}
    back = src.parse_json(messages)
    assert rows_of(back) == rows_of(df.select(*LOG_SCHEMA.fieldNames()))
    bad = spark.createDataFrame([("{",), ("[]",), (None,), ('{"source_ip": "a", "bytes_transferred": "x"}',)], "value string")
    parsed = src.parse_json(bad).collect()
    assert len(parsed) == 4 and [r["source_ip"] for r in parsed[:3]] == [None] * 3
    assert all(r["bytes_transferred"] is None for r in parsed)


def test_binary_messages_are_decoded(spark):
    df = spark.createDataFrame([(bytearray(b'{"source_ip": "a"}'),)], "value binary")
    assert src.parse_json(df).first()["source_ip"] == "a"


def test_event_time_fallback(spark):
    df = spark.createDataFrame(
        [("2026-01-01 00:00:01", "2026-01-01T00:00:09"), (None, "2026-01-01T00:00:02"), ("bad", "2026-01-01T00:00:03"), (None, "nan")],
        "event_time string, timestamp string",
    )
    got = [r["event_time"] for r in src.with_event_time(df).collect()]
    assert got == [datetime(2026, 1, 1, 0, 0, s) for s in (1, 2, 3)] + [None]
    only_text = src.with_event_time(df.drop("event_time")).collect()
    assert only_text[0]["event_time"] == datetime(2026, 1, 1, 0, 0, 9)


def test_archived_at_default(spark):
    df = logs(spark, [log()])
    assert src.with_archived_at(df).first()["archived_at"] == at(0)
    assert src.with_archived_at(df.drop("archived_at")).first()["archived_at"] is not None
    text = df.withColumn("archived_at", F.lit("2026-01-01 00:00:01"))
    assert src.with_archived_at(text).first()["archived_at"] == datetime(2026, 1, 1, 0, 0, 1)


def test_replay_slices(spark):
    df = spark.range(2700).repartition(4)
    def ids(*args):
        return [r["id"] for r in src.replay_slice(df, "id", *args).collect()]
    assert ids() == list(range(2000))
    assert ids(2000) == list(range(2000, 2700))
    assert ids(2000, 500) == list(range(2000, 2500))
    assert ids(2600, 10) == list(range(2600, 2610))
    assert ids(9000) == []
    for refused in ((0, 0), (0, -1), (-1, 5)):
        with pytest.raises(ValueError):
            ids(*refused)


def test_archive_prunes_hours_and_pushes_the_filter_on_action(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [log(event_time=at(3600 * h), action="blocked" if h % 2 else "allowed") for h in range(30)]
    archive.write_archive(logs(spark, rows + [log(event_time=None)]), path, files_per_write=2)
    assert archive.read_archive(spark, path).count() == 31
    part = archive.read_archive(spark, path, at(3600 * 3), at(3600 * 5))
    assert sorted(r["event_time"] for r in part.collect()) == [at(3600 * 3), at(3600 * 4)]
    text = plan(part)
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "hour" in filters and "year" in filters
    blocked = plan(detect.repeated_blocked(archive.read_archive(spark, path)))
    assert "EqualTo(action,blocked)" in blocked.split("PushedFilters")[1].split("]")[0]
    assert "user_agent" not in blocked
    # A bound inside an hour, over midnight.
    inside = archive.read_archive(spark, path, at(3600 * 13 + 1), at(3600 * 15 + 1))
    assert sorted(r["event_time"] for r in inside.collect()) == [at(3600 * 14), at(3600 * 15)]


def test_text_cells_and_numbers(spark):
    df = spark.createDataFrame([("3.9",), ("-2.5",), ("-",), ("",), (None,), ("abc",)], "v string")
    got = [tuple(r) for r in df.select(text_cell(F.col("v")), number_or_zero(F.col("v")), whole_or_zero(F.col("v"))).collect()]
    assert got == [("3.9", 3.9, 3), ("-2.5", -2.5, -2), ("-", 0.0, 0), ("", 0.0, 0), ("-", 0.0, 0), ("abc", 0.0, 0)]
    keys = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string").select(row_key("x", "y")).collect()
    assert [r[0] for r in keys] == ["a|-", "a|b"]


def test_netlog_reads_only_the_columns_it_needs(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    text = plan(netlog(events).select("source_ip", "dest_ip"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in text


class Settings:
    """Stands for a session with the given settings."""

    def __init__(self, **conf):
        self.conf = {key.replace("_", "."): value for key, value in conf.items()}


def test_work_dir_follows_the_setting():
    shared = Settings(spark_checkpoint_dir="hdfs://shared/folder/", spark_master="yarn")
    assert work_dir(shared, "x").startswith("hdfs://shared/folder/x-")
    assert work_dir(shared, "x") != work_dir(shared, "x")
    assert os.path.isdir(os.path.dirname(work_dir(Settings(spark_master="local[4]"), "x")))
    with pytest.raises(ValueError):
        work_dir(Settings(spark_master="yarn"), "x")


@pytest.mark.parametrize("name", ["publish_kafka", "stream_kafka"])
def test_kafka_needs_its_connector(spark, name):
    with pytest.raises(Exception, match="kafka"):
        if name == "stream_kafka":
            src.stream_kafka(spark, "localhost:1", "logs")
        else:
            src.publish_kafka(logs(spark, [log()]), "localhost:1", "logs")
