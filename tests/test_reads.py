"""Reads by key, bucketed views, absent views, retention to the second."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import at, live_row, live_table, plan, rows_of
from netsentry.plans import store
from netsentry.plans.views import VIEW_KEYS
from netsentry.streaming import jobs


def files_opened(df):
    """How many files the scans of a plan read; a filter inside them opens no others."""
    return len(df.inputFiles())


@pytest.fixture(scope="module")
def stored_view(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("views"))
    view = spark.range(2_000).select(F.format_string("10.%d.%d", F.col("id") % 40, F.col("id")).alias("src_ip"), (F.col("id") % 7).alias("total_alerts"))
    store.write_views({"ip_reputation": view}, path, files=20)
    return path


def test_point_lookup_opens_one_of_many_files(spark, stored_view):
    whole = store.read_view(spark, stored_view, "ip_reputation")
    assert len(whole.inputFiles()) == 20
    for key in ("10.7.7", "10.39.1999", "10.0.0"):
        found = store.lookup_key(spark, stored_view, "ip_reputation", key)
        assert [r.row_key for r in found.collect()] == [key] and files_opened(found) == 1
    assert store.lookup_key(spark, stored_view, "ip_reputation", "9").count() == 0


def test_prefix_lookup_opens_the_files_of_the_prefix(spark, tmp_path):
    path = str(tmp_path)
    view = spark.range(4_000).select(F.format_string("ip%02d", F.col("id") % 40).alias("src_ip"), F.format_string("T%d", F.col("id")).alias("alert_type"))
    store.write_views({"ip_attack_types": view}, path, files=20)
    found = store.lookup_key_prefix(spark, path, "ip_attack_types", "ip07")
    assert found.count() == 100 and {r.src_ip for r in found.collect()} == {"ip07"} and files_opened(found) <= 3


def test_files_have_bloom_filters_of_the_keys(spark, stored_view):
    jvm = spark._jvm
    file = store.read_view(spark, stored_view, "ip_reputation").inputFiles()[0]
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    blooms = {columns.get(k).getPath().toDotString(): columns.get(k).getBloomFilterOffset() for k in range(columns.size())}
    reader.close()
    assert blooms["row_key"] > 0 and blooms["total_alerts"] < 0


def test_old_key_ranges_go_with_their_version(spark, tmp_path):
    path = str(tmp_path)
    view = spark.createDataFrame([("a", 1)], "src_ip string, total_alerts bigint")
    for _ in range(3):
        store.write_views({"ip_reputation": view}, path)
    store.drop_old_versions(spark, path, keep=1)
    assert len(store.folders(spark, f"{path}/key_ranges/ip_reputation")) == 1
    assert store.lookup_key(spark, path, "ip_reputation", "a").count() == 1


def test_bucketed_views_join_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path)
    left = spark.range(500).select(F.format_string("ip%d", F.col("id")).alias("src_ip"), "id")
    right = spark.range(250, 900).select(F.format_string("ip%d", F.col("id")).alias("src_ip"), F.col("id").alias("other"), F.array("id").alias("list"))
    for name, df in (("left", left), ("right", right)):
        store.write_bucketed(df, f"{path}/{name}", "src_ip", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = store.read_bucketed(spark, f"{path}/left").join(store.read_bucketed(spark, f"{path}/right"), "src_ip", "full")
        assert rows_of(joined) == rows_of(left.join(right, "src_ip", "full"))
        assert "Exchange" not in plan(joined) and "Join" in plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_profile_of_bucketed_views_has_no_exchange(spark):
    from netsentry.plans.catalog import named_queries

    profile = named_queries()["ip_profile_bucketed"](spark, "/root/testdata/sf0.001")
    assert profile.count() > 0
    assert not [line for line in plan(profile).splitlines() if "Exchange hashpartitioning" in line]


def test_an_absent_view_is_an_empty_table_of_its_columns(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(KeyError):
        store.read_view_or_empty(spark, path, "ip_reputation")
    store.register_views(spark, path)
    for name in VIEW_KEYS:
        empty = store.read_view_or_empty(spark, path, name)
        assert empty.count() == 0 and "row_key" in empty.columns
    view = spark.createDataFrame([("a", 1)], "src_ip string, total_alerts bigint")
    store.write_views({"ip_reputation": view}, path)
    assert store.read_view_or_empty(spark, path, "ip_reputation").count() == 1
    assert store.read_view_or_empty(spark, path, "target_ip_stats").count() == 0
    with pytest.raises(KeyError):
        store.read_view_or_empty(spark, path, "no_such_view")


def test_registered_columns_are_those_of_a_refresh(spark, tmp_path):
    from helpers import log, logs
    from netsentry.plans import batch
    from netsentry.sources.logs import prepare

    batch.refresh_views(prepare(logs(spark, [log(user_agent="nmap")])), str(tmp_path / "full"))
    store.register_views(spark, str(tmp_path / "none"))
    for name in VIEW_KEYS:
        types = lambda df: [(f.name, f.dataType) for f in df.schema.fields]
        assert types(store.read_view_or_empty(spark, str(tmp_path / "none"), name)) == types(store.read_view(spark, str(tmp_path / "full"), name))


def live_days(spark, path):
    rows = [live_row(n, inserted_at=at(n * 3600), alert_date=at(n * 3600).date()) for n in range(60)]
    live_table(spark, rows).write.partitionBy("alert_date").parquet(path)
    return sorted(row[1] for row in rows)


def kept(spark, path):
    return sorted(r.inserted_at for r in jobs.read_compacted(spark, path).collect())


def test_expired_rows_leave_the_disk(spark, tmp_path):
    path = str(tmp_path / "live")
    times = live_days(spark, path)
    assert store.drop_expired(spark, path, at(30 * 3600)) == [at(0).date().isoformat()]
    assert kept(spark, path) == [t for t in times if t > at(30 * 3600)]
    assert store.drop_expired(spark, path, at(30 * 3600)) == []
    assert store.drop_expired(spark, path, at(30 * 3600) + timedelta(microseconds=1)) == []
    assert kept(spark, path) == [t for t in times if t > at(30 * 3600)]
    assert not [f for f in store.folders(spark, path) if f.startswith("_")]


@pytest.mark.parametrize("step", [1, 2])
def test_an_interrupted_deletion_is_finished(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "live")
    times = live_days(spark, path)
    calls, real = [], store.rename

    def stop(*args):
        calls.append(args)
        if len(calls) == step:
            raise OSError("interrupted")
        real(*args)

    monkeypatch.setattr(store, "rename", stop)
    with pytest.raises(OSError):
        store.drop_expired(spark, path, at(5 * 3600))
    monkeypatch.setattr(store, "rename", real)
    store.drop_expired(spark, path, at(5 * 3600))
    assert kept(spark, path) == [t for t in times if t > at(5 * 3600)]
    assert not [f for f in store.folders(spark, path) if f.startswith("_")]
