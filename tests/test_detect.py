import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import START, at, log, logs, plan, rows_of
from netsentry.operators import detect
from netsentry.schema import BATCH_ALERT_SCHEMA, LIVE_ALERT_SCHEMA
from netsentry.sources.logs import normalize

MIB = 1024 * 1024


def random_logs(spark, n=3000, seed=7):
    """A third of the rows from one source; odd times, gaps and nulls."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        second = rng.randrange(-700, 700) + rng.choice((0, 0.25))
        rows.append(
            log(
                source_ip="10.0.0.9" if rng.random() < 0.34 else rng.choice(("10.0.0.1", "10.0.0.2", None)),
                protocol=rng.choice(("TCP", "SSH", None)),
                action=rng.choice(("blocked", "allowed", None)),
                bytes_transferred=rng.choice((None, 10, 200_000)),
                event_time=at(second - 5),
                archived_at=None if rng.random() < 0.05 else at(second),
            )
        )
    return logs(spark, rows)


def brute_windows(df, threshold):
    groups = defaultdict(list)
    for r in df.collect():
        if r["action"] != "blocked" or r["archived_at"] is None:
            continue
        pane = int((r["archived_at"] - START).total_seconds() // 10 * 10)
        for back in range(0, 60, 10):
            groups[(r["source_ip"], r["protocol"], pane - back)].append(r)
    out = []
    for (ip, protocol, _), rs in groups.items():
        if len(rs) >= threshold:
            sizes = [r["bytes_transferred"] for r in rs if r["bytes_transferred"] is not None]
            out.append((ip, protocol, max(r["event_time"] for r in rs), max(r["archived_at"] for r in rs),
                        sum(sizes) if sizes else None))
    return sorted(out, key=repr)


def brute_volumes(df, threshold):
    groups = defaultdict(list)
    for r in df.collect():
        groups[(r["source_ip"], r["protocol"])].append(r)
    out = []
    for (ip, protocol), rs in groups.items():
        total = sum(r["bytes_transferred"] or 0 for r in rs)
        if total > threshold:
            out.append((ip, protocol, max(r["event_time"] for r in rs),
                        max(r["archived_at"] for r in rs if r["archived_at"] is not None), total))
    return sorted(out, key=repr)


MEASURES = ("src_ip", "protocol", "event_time", "archived_at", "bytes_transferred")


def test_repeated_blocked_equals_brute_force(spark):
    df = random_logs(spark)
    # Fourteen hundred seconds touch four stretches of ten windows.
    for threshold in (3, 7):
        got = rows_of(detect.repeated_blocked(df, threshold=threshold).select(*MEASURES))
        assert got == brute_windows(df, threshold) != []


def test_activity_is_both_detectors_in_one_scan(spark, tmp_path):
    random_logs(spark).write.parquet(str(tmp_path / "logs"))
    df = spark.read.parquet(str(tmp_path / "logs"))
    both = detect.activity(df, min_events=5, min_bytes=20 * MIB)
    apart = detect.repeated_blocked(df, threshold=5).unionByName(detect.volume_total(df, 20 * MIB))
    assert rows_of(both) == rows_of(apart)
    volumes = both.filter(F.col("alert_type") == "DATA_EXFILTRATION")
    assert rows_of(volumes.select(*MEASURES)) == brute_volumes(df, 20 * MIB) != []
    text = plan(both)
    assert text.count("FileScan") == 1 and "user_agent" not in text and "request_path" not in text


def test_a_burst_gives_one_alert_per_window(spark):
    rows = [log(action="blocked", archived_at=at(30), event_time=at(k)) for k in range(5)]
    df = logs(spark, rows)
    got = detect.repeated_blocked(df).collect()
    assert len(got) == 6 and {r["bytes_transferred"] for r in got} == {500}
    assert {(r["dest_ip"], r["path"], r["threat_label"], r["action"]) for r in got} == {
        ("-", "authentication-target", "suspicious", "blocked")
    }
    assert detect.repeated_blocked(logs(spark, rows[:4])).isEmpty()


def test_the_key_is_source_and_protocol(spark):
    rows = [log(action="blocked", protocol=p) for p in ("TCP", "TCP", "TCP", "SSH", "SSH")]
    assert detect.repeated_blocked(logs(spark, rows)).isEmpty()


def test_window_parameters(spark):
    with pytest.raises(ValueError):
        detect.repeated_blocked(logs(spark, [log()]), size=60, slide=7)
    rows = [log(action="blocked", event_time=at(s)) for s in (0, 3, 6)]
    tumbling = detect.repeated_blocked(logs(spark, rows), "event_time", size=10, slide=10, threshold=3)
    assert tumbling.count() == 1


def test_volume_threshold_is_exclusive(spark):
    exact = logs(spark, [log(bytes_transferred=5 * MIB)] * 2)
    assert detect.volume_total(exact).isEmpty()
    above = logs(spark, [log(bytes_transferred=5 * MIB)] * 2 + [log(bytes_transferred=1)])
    row = detect.volume_total(above).first()
    assert (row["bytes_transferred"], row["threat_label"], row["action"], row["dest_ip"], row["path"]) == (
        10 * MIB + 1, "malicious", "allowed", "-", "high-volume-transfer",
    )


def test_totals_beyond_the_int_range(spark):
    df = logs(spark, [log(bytes_transferred=2**31 - 1)] * 3)
    assert detect.live_volume(df).first()["count_value"] == 3 * (2**31 - 1)
    assert detect.volume_total(df).first()["bytes_transferred"] == 3 * (2**31 - 1)


def test_all_alerts_is_a_bag(spark):
    df = logs(spark, [log(user_agent="nmap"), log(user_agent="nmap"), log(bytes_transferred=20 * MIB)])
    got = detect.all_alerts(df)
    assert got.schema.simpleString() == BATCH_ALERT_SCHEMA.simpleString()
    assert sorted(r["alert_type"] for r in got.collect()) == ["DATA_EXFILTRATION", "NMAP", "NMAP"]


def test_live_windows(spark):
    rows = [log(action="blocked", event_time=at(s), bytes_transferred=6 * MIB) for s in (1, 2, 3, 4, 19)]
    df = logs(spark, rows)
    blocked = detect.live_repeated_blocked(df)
    assert blocked.schema.simpleString() == LIVE_ALERT_SCHEMA.simpleString()
    # All five are in the windows that start at -40, -30, -20, -10 and 0 (ends 20 to 60).
    assert sorted(r["event_time"] for r in blocked.collect()) == [at(s) for s in (20, 30, 40, 50, 60)]
    volume = detect.live_volume(df).collect()
    assert [(r["count_value"], r["event_time"]) for r in volume] == [(24 * MIB, at(10))]


def test_normalize_makes_the_filters_case_insensitive(spark):
    df = normalize(logs(spark, [log(action="BLOCKED", threat_label="Malicious", user_agent="NMAP")] * 5))
    assert detect.repeated_blocked(df).count() == 6
    assert {r["threat_label"] for r in detect.signature(df).collect()} == {"malicious"}
