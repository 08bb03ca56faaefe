from datetime import date

from pyspark.sql import functions as F

from helpers import alert, alerts, at, log, logs, plan, rows_of
from netsentry.operators.rollup import rollup
from netsentry.plans import batch, serving, store, views


def test_refresh_publishes_all_views_at_once(spark, tmp_path):
    path = str(tmp_path / "views")
    df = logs(spark, [log(user_agent="nmap"), log(source_ip="10.9.0.2", request_path="/.git")])
    first = batch.refresh_views(df, path)
    assert store.current_version(spark, path) == first
    for name in views.VIEW_KEYS:
        assert "row_key" in store.read_view(spark, path, name).columns
    reputation = store.read_view(spark, path, "ip_reputation")
    assert {r["row_key"] for r in reputation.collect()} == {"10.9.0.1", "10.9.0.2"}

    # A version that is written but not published is not seen, and the old one stays readable.
    store.write_view("ip_reputation", reputation.drop("row_key").limit(0), path, "zzz")
    assert store.current_version(spark, path) == first
    second = batch.refresh_views(logs(spark, [log(user_agent="nikto")]), path)
    assert second > first and store.current_version(spark, path) == second
    assert store.read_view(spark, path, "ip_reputation").count() == 1
    assert store.read_view(spark, path, "ip_reputation", first).count() == 2


def test_lookups_are_pushed_to_the_files(spark, tmp_path):
    path = str(tmp_path / "views")
    df = alerts(spark, [alert(src_ip=f"10.9.0.{k}", dest_ip=f"t{k % 3}") for k in range(200)])
    store.write_views(views.all_views(df, rollup(df)), path, "v1")
    pairs = store.read_view(spark, path, "ip_attack_types")
    one = store.lookup(pairs, "10.9.0.7|NMAP")
    assert [r["src_ip"] for r in one.collect()] == ["10.9.0.7"]
    assert "EqualTo(row_key,10.9.0.7|NMAP)" in plan(one)
    some = store.lookup_prefix(pairs, "10.9.0.1")
    assert [r["src_ip"] for r in some.collect()] == ["10.9.0.1"]
    assert "StringStartsWith(row_key,10.9.0.1|)" in plan(some)


def test_history_rows_of_equal_key_replace_each_other(spark):
    rows = [alert(bytes_transferred=b) for b in (5, 9, 7)] + [alert(path="/y"), alert(path=None)]
    history = views.ip_historical_alerts(alerts(spark, rows))
    assert history.count() == 5
    keyed = views.with_row_key("ip_historical_alerts", history)
    assert keyed.count() == 3 and {r["bytes_transferred"] for r in keyed.collect()} == {9, 100}


def test_history_of_one_ip_is_the_newest(spark):
    rows = [alert(archived_at=at(k), path=f"/{k}") for k in range(10)] + [alert(src_ip="10.9.0.11")]
    keyed = views.with_row_key("ip_historical_alerts", views.ip_historical_alerts(alerts(spark, rows)))
    got = serving.ip_history(keyed, "10.9.0.1", limit=3).collect()
    assert [r["archived_at"] for r in got] == [at(9), at(8), at(7)]


def test_text_export_and_kpi_row(spark):
    df = spark.createDataFrame([("a", None, 3), ("b", "x", None)], "row_key string, name string, n int")
    text = store.export_text(df)
    assert rows_of(text) == [("a", "-", "3"), ("b", "x", "-")]
    kpi = spark.createDataFrame([(17,)], "total_unique_targets long")
    with_kpi = store.with_kpi_row(text, kpi)
    reserved = with_kpi.filter(F.col("row_key") == "__KPI_TOTAL__").first()
    assert reserved["total_unique_targets"] == "17" and reserved["row_type"] == "kpi" and reserved["name"] is None
    assert rows_of(store.without_kpi_row(with_kpi)) == rows_of(text)


def test_numeric_order_of_text(spark):
    df = spark.createDataFrame([("a", "9"), ("b", "10"), ("c", "-"), ("d", "x"), ("e", "-1")], "row_key string, v string")
    assert [r["row_key"] for r in serving.top_by_number(df, "v", 10, "row_key").collect()] == list("bacde")


def test_old_versions_are_dropped(spark, tmp_path):
    path = str(tmp_path / "views")
    df = alerts(spark, [alert()])
    view = {"ip_reputation": views.ip_reputation(rollup(df))}
    for version in ("v1", "v2", "v3"):
        store.write_views(view, path, version)
    store.write_view("ip_reputation", view["ip_reputation"], path, "v4")
    assert store.drop_old_versions(spark, path, keep=2) == ["v1"]
    assert store.folders(spark, f"{path}/ip_reputation") == ["version=v2", "version=v3", "version=v4"]
    assert store.read_view(spark, path, "ip_reputation").count() == 1


def test_expired_days_are_dropped(spark, tmp_path):
    path = str(tmp_path / "live")
    rows = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2), (None, 3)], "alert_date string, n int")
    rows.withColumn("alert_date", F.col("alert_date").cast("date")).write.partitionBy("alert_date").parquet(path)
    assert store.drop_expired_days(spark, path, date(2026, 1, 2)) == ["2026-01-01"]
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 3]
    assert store.drop_expired_days(spark, str(tmp_path / "none"), date(2026, 1, 2)) == []
