import pytest
from pyspark.sql import functions as F

from helpers import alert, alerts, at, live_row, live_table, plan, rows_of
from netsentry.functions.score import recommendation
from netsentry.operators.live import retained, stored
from netsentry.operators.rollup import rollup
from netsentry.plans import serving, store, views

DAY = at(0).date()


def test_feed_limit():
    assert [serving.feed_limit(v) for v in (20, "1000", None)] == [20, 1000, 100]
    for refused in (99, "x", -5):
        with pytest.raises(ValueError):
            serving.feed_limit(refused)


def test_feed_is_newest_first_and_filtered(spark):
    rows = [live_row(k, source_ip=f"10.9.0.{k % 2}") for k in range(30)]
    rows += [live_row(99, alert_date=at(86400 * 2).date())]
    table = live_table(spark, rows)
    got = serving.live_feed(table, DAY, 5).collect()
    assert [r["display_time"] for r in got] == ["10:00:29", "10:00:28", "10:00:27", "10:00:26", "10:00:25"]
    assert got[0]["raw_time"] == "2026-01-05T10:00:29"
    assert {r["src_ip"] for r in serving.live_feed(table, DAY, 100, "10.9.0.1").collect()} == {"10.9.0.1"}
    assert serving.live_feed(table, None, 100).count() == 31


def test_times_of_the_feed(spark):
    rows = [live_row(0, inserted_at=None), live_row(1, inserted_at=None, event_time=None), live_row(2, inserted_at=at(2.5))]
    got = {r["raw_time"]: r["display_time"] for r in serving.live_feed(live_table(spark, rows), DAY).collect()}
    assert got == {"2026-01-05T10:00:00": "10:00:00", None: "N/A", "2026-01-05T10:00:02.500000": "10:00:02"}


@pytest.mark.parametrize("page, want", [(1, range(24, 14, -1)), (3, range(4, -1, -1)), (4, [])])
def test_pages(spark, page, want):
    got = serving.live_feed_page(live_table(spark, [live_row(k) for k in range(25)]), DAY, page, page_size=10).collect()
    assert [r["display_time"] for r in got] == [f"10:00:{s:02d}" for s in want]
    assert {r["pages"] for r in got} <= {3} and {r["page"] for r in got} <= {page}


def test_pages_reach_every_alert(spark):
    table = live_table(spark, [live_row(k % 7, alert_id=f"id{k:05d}") for k in range(2345)])
    got = [r for page in (1, 12, 24) for r in serving.live_feed_page(table, DAY, page).collect()]
    want = sorted(range(2345), key=lambda k: (k % 7, k), reverse=True)
    positions = [*range(1, 101), *range(1101, 1201), *range(2301, 2346)]
    assert [r["position"] for r in got] == positions
    assert [r["display_time"] for r in got] == [f"10:00:{want[p - 1] % 7:02d}" for p in positions]
    for page in (0, -1):
        with pytest.raises(ValueError):
            serving.live_feed_page(table, DAY, page)


def test_one_ip_is_filtered_in_the_files(spark, tmp_path):
    """The address reaches the scan of each stored table before any join or ranking."""
    rows = [alert(src_ip=f"10.9.0.{k % 9}", dest_ip=f"t{k % 5}", archived_at=at(k)) for k in range(90)]
    df = alerts(spark, rows)
    path = str(tmp_path / "views")
    store.write_views(views.all_views(df, rollup(df)), path, "v1")
    live_path = str(tmp_path / "live")
    live_table(spark, [live_row(k, source_ip=f"10.9.0.{k % 9}") for k in range(40)]).write.parquet(live_path)
    live = spark.read.parquet(live_path)
    read = {name: store.read_view(spark, path, name) for name in views.VIEW_KEYS}
    one = "10.9.0.4"
    frames = {
        "relations": serving.ip_relations(read["attacker_victim_stats"], ip=one),
        "types": serving.ip_top_types(read["ip_attack_types"], ip=one),
        "history": serving.ip_recent_history(read["ip_historical_alerts"], ip=one),
        "profile": serving.ip_profile(read["ip_reputation"], read["global_ip_stats"], serving.live_summary(live, DAY), one),
    }
    for name, frame in frames.items():
        assert {r["src_ip"] for r in frame.collect()} == {one}
        assert f"EqualTo(src_ip,{one})" in plan(frame), name
    newest = serving.live_newest_per_ip(live, None, ip=one)
    assert {r["src_ip"] for r in newest.collect()} == {one} and f"EqualTo(source_ip,{one})" in plan(newest)
    assert plan(frames["profile"]).count(f"EqualTo(src_ip,{one})") == 2


def test_lists_without_a_limit(spark):
    df = alerts(spark, [alert(dest_ip=f"t{k}") for k in range(250)])
    pairs = views.attacker_victim_stats(rollup(df), limit=None)
    assert serving.ip_relations(pairs).count() == 30 and serving.ip_relations(pairs, limit=None).count() == 250


def test_pages_of_an_empty_feed(spark):
    assert serving.live_feed_page(live_table(spark, []), DAY, 1).isEmpty()


def test_kpis(spark):
    got = serving.live_kpis(live_table(spark, [live_row(k, source_ip=f"s{k % 3}") for k in range(9)]), DAY, loaded=2).first()
    assert (got["live_total"], got["loaded"], got["live_ips"], got["live_last"]) == (9, 2, 2, "10:00:08")
    empty = serving.live_kpis(live_table(spark, []), DAY).first()
    assert (empty["live_total"], empty["live_ips"], empty["live_last"]) == (0, 0, "--:--:--")


def test_summary_and_dimensions(spark):
    rows = [
        live_row(0, alert_type="SQLMAP", dest_ip="t1"),
        live_row(1, alert_type="WP_LOGIN", dest_ip="-", protocol="-"),
        live_row(2, alert_type=None, dest_ip="t2", protocol=None),
        live_row(3, alert_type="DATA_EXFILTRATION", dest_ip=None, protocol=""),
    ]
    table = live_table(spark, rows)
    got = serving.live_summary(table, DAY).first().asDict()
    assert got["active_alerts"] == 4 and got["last_seen"] == at(3)
    assert (got["unique_targets_live"], got["unique_protocols_live"]) == (2, 1)
    families = ("scan", "sqli", "xss", "bruteforce", "exfiltration")
    assert [got[f"{f}_live"] for f in families] == [0, 1, 0, 1, 1]
    counts = {(r["dimension"], r["value"]): r["alerts"] for r in serving.live_dimension_counts(table, DAY).collect()}
    assert counts[("dest_ip", "-")] == 2 and counts[("protocol", "-")] == 3 and counts[("alert_type", "-")] == 1
    assert sum(v for (d, _), v in counts.items() if d == "alert_type") == 4


def test_summary_of_the_newest_rows_only(spark):
    table = live_table(spark, [live_row(k) for k in range(10)])
    newest = serving.of_day(table, DAY, "10.9.0.1").orderBy(*serving.newest_first()).limit(4)
    assert serving.live_summary(newest, None).first()["active_alerts"] == 4


def test_risk_distribution(spark):
    df = spark.createDataFrame(
        [("high", 0), ("CRITICAL", 0), (None, 99), ("odd", 85), ("odd", 61), ("odd", None)], "risk_level string, risk_score int"
    )
    assert {r["name"]: r["value"] for r in serving.risk_distribution(df).collect()} == {
        "LOW": 2, "MEDIUM": 0, "HIGH": 2, "CRITICAL": 2,
    }
    assert serving.risk_distribution(df.limit(0)).count() == 4


@pytest.mark.parametrize(
    "values, level",
    [((80, 0, 0, 0), "CRITICAL"), ((0, 10, 0, 0), "CRITICAL"), ((0, 1, 5, 0), "CRITICAL"), ((79, 9, 4, 0), "HIGH"),
     ((60, 0, 0, 0), "HIGH"), ((0, 4, 0, 4), "HIGH"), ((59, 4, 4, 3), "MEDIUM"), ((0, 1, 0, 0), "MEDIUM"),
     ((30, 0, 0, 0), "MEDIUM"), ((29, 0, 0, 0), "LOW"), ((None, None, None, None), "LOW")],
)
def test_recommendation(spark, values, level):
    df = spark.createDataFrame([values], "a int, b int, c int, d int")
    assert df.select(recommendation(*[F.col(c) for c in "abcd"])).first()[0] == level


def profile_of(spark):
    rolled = rollup(alerts(spark, [alert(alert_type="SQLMAP", threat_label="malicious")] * 3 + [alert(src_ip="batch only")]))
    live = live_table(spark, [live_row(k, alert_type="SQLI_UNION") for k in range(5)] + [live_row(9, source_ip="live only")])
    return serving.ip_profile(views.ip_reputation(rolled), views.global_ip_stats(rolled), serving.live_summary(live, DAY))


def test_profile(spark):
    got = {r["src_ip"]: r.asDict() for r in profile_of(spark).collect()}
    assert set(got) == {"10.9.0.1", "batch only", "live only"}
    both = got["10.9.0.1"]
    assert (both["total_alerts_visible"], both["sqli_total_visible"], both["recommended_level"]) == (8, 8, "CRITICAL")
    assert both["recommended_action"] == "BLOCK_IP" and both["historical_source"] == "ip_reputation"
    assert (got["batch only"]["active_alerts"], got["batch only"]["recommended_level"]) == (0, "LOW")
    assert got["live only"]["historical_source"] == "none" and got["live only"]["recommended_level"] == "MEDIUM"


def test_profile_falls_back_to_global_stats(spark):
    rolled = rollup(alerts(spark, [alert(), alert()]))
    reputation = views.ip_reputation(rolled).limit(0)
    live = live_table(spark, [live_row(1)])
    got = serving.ip_profile(reputation, views.global_ip_stats(rolled), serving.live_summary(live, DAY)).first()
    assert (got["historical_source"], got["total_alerts"], got["scan_total_visible"]) == ("global_ip_stats", 2, 3)


def test_signal_matrix(spark):
    got = {(r["src_ip"], r["signal"]): (r["batch"], r["live"], r["total"]) for r in serving.signal_matrix(profile_of(spark)).collect()}
    assert got == {
        ("10.9.0.1", "Logs malveillants"): (3, 0, 3),
        ("10.9.0.1", "SQLi / SQLMap"): (3, 5, 8),
        ("batch only", "Scans"): (1, 0, 1),
        ("live only", "Scans"): (0, 1, 1),
    }


def test_last_live(spark):
    reputation = spark.createDataFrame([("a",), ("b",), ("c",)], "src_ip string")
    live = live_table(spark, [live_row(k, source_ip="a" if k < 5 else "b") for k in range(10)])
    def last(newest):
        return {r["src_ip"]: r["last_live"] for r in serving.with_last_live(reputation, live, DAY, newest).collect()}
    assert last(5) == {"a": None, "b": at(9), "c": None}
    assert last(None) == {"a": at(4), "b": at(9), "c": None}


def test_stored_defaults_and_stable_id(spark):
    schema = "src_ip string, dest_ip string, protocol string, user_agent string, path string, alert_type string, count_value long, event_time timestamp"
    df = spark.createDataFrame([("a", None, None, None, None, "NMAP", None, None), ("a", "b", "TCP", "x", "/", "NMAP", 7, at(3))], schema)
    first = stored(df, F.lit(at(60))).orderBy(F.col("count_value").asc_nulls_first()).collect()
    gap = first[0]
    assert [gap[c] for c in ("dest_ip", "protocol", "user_agent", "request_path")] == ["-"] * 4
    assert gap["event_time"] == at(60) and gap["count_value"] is None and gap["alert_date"] == DAY
    again = stored(df, F.lit(at(99))).orderBy(F.col("count_value").asc_nulls_first()).collect()
    assert first[1]["alert_id"] == again[1]["alert_id"] and len(first[1]["alert_id"]) == 64


def test_retention(spark):
    rows = [live_row(h, inserted_at=at(3600 * h), alert_date=at(3600 * h).date()) for h in range(0, 60, 6)]
    kept = retained(live_table(spark, rows), F.lit(at(3600 * 54)))
    assert sorted(r["inserted_at"] for r in kept.collect()) == [at(3600 * h) for h in (36, 42, 48, 54)]


def test_per_ip_lists(spark):
    pairs = views.attacker_victim_stats(
        rollup(alerts(spark, [alert(src_ip=f"s{k % 2}", dest_ip=f"t{k % 40:02d}") for k in range(400)])), limit=None
    )
    got = serving.ip_relations(pairs, limit=3).collect()
    assert rows_of(serving.ip_relations(pairs, limit=3).select("src_ip", "position")) == [
        (s, p) for s in ("s0", "s1") for p in (1, 2, 3)
    ]
    assert len(got) == 6


def test_timeline_tail_and_lists(spark):
    df = alerts(spark, [alert(archived_at=at(60 * k), src_ip=f"s{k:03d}") for k in range(40)])
    tail = serving.timeline_tail(views.threat_timeline(df), 3).collect()
    assert [r["time_bucket"][-8:] for r in tail] == ["10:37:00", "10:38:00", "10:39:00"]
    rolled = rollup(df)
    lists = serving.top_lists(
        {"ip_reputation": views.ip_reputation(rolled), "global_ip_stats": views.global_ip_stats(rolled)},
        {"ip_reputation": ("risk_score", 10), "global_ip_stats": ("alert_count", 2)},
    ).collect()
    assert len(lists) == 12 and {r["position"] for r in lists if r["list"] == "global_ip_stats"} == {1, 2}
