import pytest
from pyspark.sql import functions as F

from helpers import alert, alerts, at, plan, rows_of
from netsentry.functions.score import attack_counts_text, dominant_attack, relation_level, risk_level
from netsentry.operators.rollup import rollup
from netsentry.operators.topk import newest, top_per_key
from netsentry.plans import views


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        alert(alert_type="SQLMAP", threat_label="malicious", action="blocked", dest_ip="t1", archived_at=at(0)),
        alert(alert_type="SQLI_UNION", dest_ip="t2", protocol="SSH", archived_at=at(70), event_time=at(-60)),
        alert(alert_type="REPEATED_BLOCKED_ACTIVITY", dest_ip="-", threat_label="suspicious", action="blocked"),
        alert(src_ip="10.9.0.2", alert_type="METASPLOIT", dest_ip=None, bytes_transferred=None),
        alert(src_ip="10.9.0.2", alert_type="WP_LOGIN", dest_ip="t1", protocol=None, bytes_transferred=51),
    ]
    return alerts(spark, rows).cache()


def row(df, **keys):
    for name, value in keys.items():
        df = df.filter(F.col(name) == value)
    return df.first().asDict()


def test_reputation(sample):
    got = row(views.ip_reputation(rollup(sample)), src_ip="10.9.0.1")
    assert got["total_alerts"] == 3 and got["sqli_count"] == 2 and got["bruteforce_count"] == 1
    assert got["unique_targets"] == 3  # the placeholder counts as a target here
    assert got["unique_protocols"] == 2 and got["total_bytes"] == 300
    assert (got["first_seen"], got["last_archived_at"]) == (at(-60), at(70))
    assert got["risk_score"] == 5 + 2 + 2 * 1 + 2 * 4 + 4 + 3 * 2
    other = row(views.ip_reputation(rollup(sample)), src_ip="10.9.0.2")
    assert other["unique_targets"] == 1 and other["unique_protocols"] == 1 and other["risk_level"] == "LOW"


def test_targets_and_pairs_leave_out_placeholder_and_null(sample):
    assert {r["dest_ip"] for r in views.target_ip_stats(rollup(sample)).collect()} == {"t1", "t2"}
    assert views.attacker_victim_stats(rollup(sample)).count() == 3
    assert views.total_unique_targets(sample).first()[0] == 2
    t1 = row(views.target_ip_stats(rollup(sample)), dest_ip="t1")
    assert t1["unique_attackers"] == 2 and t1["target_risk_score"] == 2 + 2 * 3 + 5 + 4 + 2


def test_views_agree_with_each_other(sample):
    rolled = rollup(sample)
    total = sample.count()
    for view, column in (
        (views.ip_reputation(rolled), "total_alerts"),
        (views.global_protocol_stats(rolled), "alert_count"),
        (views.global_attack_patterns(rolled), "alert_count"),
        (views.ip_attack_types(rolled), "alert_count"),
        (views.threat_timeline(sample), "total_alerts"),
    ):
        assert view.agg(F.sum(column)).first()[0] == total
    by_type = views.ip_attack_types(rolled).groupBy("alert_type").agg(F.sum("alert_count").alias("alert_count"))
    assert rows_of(by_type) == rows_of(views.global_attack_patterns(rolled).select("alert_type", "alert_count"))


def test_average_is_rounded(spark):
    got = views.global_protocol_stats(rollup(alerts(spark, [alert(bytes_transferred=b) for b in (1, 1, 0)]))).first()
    assert got["avg_bytes_per_alert"] == 0.67


def test_timeline_buckets_the_archive_time(sample):
    assert [r["time_bucket"] for r in views.ordered("threat_timeline", views.threat_timeline(sample)).collect()] == [
        "2026-01-05 10:00:00", "2026-01-05 10:01:00",
    ]
    by_event = views.threat_timeline(sample, "event_time")
    assert {r["time_bucket"] for r in by_event.collect()} == {"2026-01-05 09:59:00", "2026-01-05 10:00:00"}


def test_score_is_capped_and_high_risk_is_cut_only_on_request(spark):
    df = alerts(spark, [alert(src_ip=f"s{k:03d}", threat_label="malicious") for k in range(60) for _ in range(20)])
    reputation = views.ip_reputation(rollup(df))
    assert {r["risk_score"] for r in reputation.collect()} == {100}
    assert views.high_risk_ips(reputation, limit=None).count() == 60
    assert [r["src_ip"] for r in views.high_risk_ips(reputation).collect()] == [f"s{k:03d}" for k in range(50)]


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (29, 30, 59, 60, 79, 80)], "s long")
    assert [r[0] for r in df.select(risk_level(F.col("s"))).collect()] == [
        "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL",
    ]
    df = spark.createDataFrame([(s,) for s in (19, 20, 49, 50, 79, 80)], "s long")
    assert [r[0] for r in df.select(relation_level(F.col("s"))).collect()] == [
        "Faible", "Moyen", "Moyen", "Élevé", "Élevé", "Critique",
    ]


def test_dominant_attack_and_text(spark):
    names = "sqli_count, scan_count, xss_count, exfiltration_count, file_attack_count, admin_probe_count, sensitive_file_count, command_injection_count"
    df = spark.createDataFrame(
        [(0, 3, 3, 0, 0, 0, 0, 1), (0,) * 8, (None, 0, 0, 0, 2, 0, 0, 0)], ", ".join(f"{n.strip()} long" for n in names.split(","))
    )
    got = [tuple(r) for r in df.select(dominant_attack(), attack_counts_text()).collect()]
    assert got == [
        ("Scan (3)", "Scan=3 | XSS=3 | Command injection=1"), ("-", "-"), ("Accès fichiers (2)", "Accès fichiers=2"),
    ]


@pytest.mark.parametrize("n", [1, 5, 17, 40, 1000])
def test_newest_equals_a_plain_sort(spark, n):
    rows = [(k % 7 if k % 11 else None, k % 3 if k % 5 else None, k) for k in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, id int").repartition(5)
    want = df.orderBy(F.col("a").desc(), F.col("b").desc(), "id").limit(n).collect()
    assert newest(df, n, ("a", "b"), ("id",)).collect() == want


@pytest.mark.parametrize("n", [1, 30, 500, 900, 5000])
def test_newest_by_time_with_one_hot_second(spark, n):
    """Most rows share one second; the narrowing by hour, minute and second must not cut through it."""
    rows = [(at(0) if k % 3 else at(-(k % 5) * 1800 + k % 7) if k % 4 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "t timestamp, id int").repartition(6)
    want = df.orderBy(F.col("t").desc(), "id").limit(n).collect()
    assert newest(df, n, ("t",), ("id",)).collect() == want


def test_top_per_key_equals_a_plain_ranking(spark):
    # One key owns most of the rows.
    rows = [("hot" if k % 3 else f"k{k % 9}", k * 7919 % 1000, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "key string, score int, id int").repartition(9)
    got = top_per_key(df, "key", [F.col("score").desc(), F.col("id").asc()], 20, buckets=4)
    want = []
    for key in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:20]
        want += [(*r, position) for position, r in enumerate(best, 1)]
    assert rows_of(got.select("key", "score", "id", "position")) == sorted(want, key=repr)
    text = plan(got)
    assert text.count("WindowGroupLimit") == 4
