"""Stored tables: intermediate results and versioned serving views."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsentry.functions.text import text_cell
from netsentry.plans.views import all_views, with_row_key
from netsentry.operators.rollup import rollup
from netsentry.schema import BATCH_ALERT_SCHEMA
from netsentry.session import work_dir


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes a frame that several plans read and gives the stored table.

    The result does not depend on the executors that computed it, and each reader prunes its own columns.
    """
    spark = df.sparkSession
    path = path or work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def export_text(view: DataFrame) -> DataFrame:
    """Every column as a text cell, null as `-`."""
    return view.select(*[text_cell(F.col(name)).alias(name) for name in view.columns])


def with_kpi_row(view: DataFrame, kpi: DataFrame, key: str = "__KPI_TOTAL__") -> DataFrame:
    """A text export with the KPI appended under a reserved row key, for readers that expect it there."""
    row = kpi.select(F.lit(key).alias("row_key"), F.lit("kpi").alias("row_type"), *kpi.columns)
    return view.unionByName(export_text(row), allowMissingColumns=True)


def without_kpi_row(view: DataFrame, key: str = "__KPI_TOTAL__") -> DataFrame:
    is_kpi = (F.col("row_key") == key) | F.coalesce(F.col("row_type") == "kpi", F.lit(False))
    return view.filter(~is_kpi).drop("row_type", "total_unique_targets")


def new_version() -> str:
    """Versions sort by time."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:8]


def write_view(name: str, view: DataFrame, path: str, version: str, files: int | None = None) -> None:
    """Writes one version of a view, clustered by row key, so that the row-group statistics of the files serve
    point and prefix reads by key, with a Bloom filter of the keys in each row group and the key range of each file
    beside it. `files` is their number; by default it follows the size."""
    keyed = with_row_key(name, view)
    clustered = keyed.repartitionByRange("row_key") if files is None else keyed.repartitionByRange(files, "row_key")
    folder = f"{path}/{name}/version={version}"
    (
        clustered.sortWithinPartitions("row_key").write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#row_key", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(folder)
    )
    # Reads the keys alone. A row per file.
    ranges = keyed.sparkSession.read.schema("row_key string").parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"))
    ranges = ranges.agg(F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key"), F.count(F.lit(1)).alias("rows"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/key_ranges/{name}/version={version}")


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes a completely written version the current one, for all views at once. Readers of the version before
    keep a consistent set of tables."""
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/published")


def write_views(views: dict[str, DataFrame], path: str, version: str | None = None, files: int | None = None) -> str:
    """Writes all views as one new version and publishes it."""
    version = version or new_version()
    for name, view in views.items():
        write_view(name, view, path, version, files)
    publish(next(iter(views.values())).sparkSession, path, version)
    return version


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/published").agg(F.max("version")).first()[0]


def read_view(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """The current version of a view, or a given one."""
    return spark.read.parquet(f"{path}/{name}/version={version or current_version(spark, path)}")


def register_views(spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None) -> None:
    """Notes the columns of views that the store may hold, before any of them is written; by default of all ten. A view
    that is noted again has the columns of the last time."""
    if schemas is None:
        nothing = spark.createDataFrame([], BATCH_ALERT_SCHEMA)
        schemas = {name: with_row_key(name, view).schema for name, view in all_views(nothing, rollup(nothing)).items()}
    rows = [(name, new_version(), schema.json()) for name, schema in schemas.items()]
    spark.createDataFrame(rows, "view string, noted string, columns string").coalesce(1).write.mode("append").parquet(f"{path}/registry")


def read_view_or_empty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The current version of a view; an empty table of its columns where it has not been written yet, or the store has
    no version at all. A name that the registry does not know either raises KeyError."""
    if exists(spark, f"{path}/published"):
        version = current_version(spark, path)
        if exists(spark, f"{path}/{name}/version={version}"):
            return read_view(spark, path, name, version)
    noted = None
    if exists(spark, f"{path}/registry"):
        noted = spark.read.parquet(f"{path}/registry").filter(F.col("view") == name).orderBy(F.col("noted").desc()).first()
    if noted is None:
        raise KeyError(f"no view is called {name}")
    return spark.createDataFrame([], T.StructType.fromJson(json.loads(noted["columns"])))


def _files_with(spark: SparkSession, path: str, name: str, first: str, last: str) -> DataFrame:
    """The current version of a view, only the files that may hold keys from `first` to `last`."""
    version = current_version(spark, path)
    ranges = spark.read.parquet(f"{path}/key_ranges/{name}/version={version}")
    found = ranges.filter((F.col("first_key") <= last) & (F.col("last_key") >= first)).select("file").collect()
    whole = read_view(spark, path, name, version)
    files = [row["file"] for row in found]
    return spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)


def lookup_key(spark: SparkSession, path: str, name: str, key: str) -> DataFrame:
    """The row of one key of a stored view. The key ranges leave one file (two at most, where a key ends one and begins
    the next), and its statistics and Bloom filters leave the row groups that may hold the key."""
    return lookup(_files_with(spark, path, name, key, key), key)


def lookup_key_prefix(spark: SparkSession, path: str, name: str, prefix: str) -> DataFrame:
    """The rows of a stored view whose key starts with `prefix|`, from the files that may hold such keys."""
    return lookup_prefix(_files_with(spark, path, name, f"{prefix}|", f"{prefix}|\U0010ffff"), prefix)


def lookup(view: DataFrame, key: str) -> DataFrame:
    """The row of one key; the equality is pushed to the files."""
    return view.filter(F.col("row_key") == key)


def lookup_prefix(view: DataFrame, prefix: str) -> DataFrame:
    """The rows whose key starts with `prefix|`; the prefix is pushed to the files."""
    return view.filter(F.col("row_key").startswith(f"{prefix}|"))


def _file_system(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms: whatever store the tables are in."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at the path, in order; none if it does not exist."""
    files, root = _file_system(spark, path)
    if not files.exists(root):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(root) if status.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    files, root = _file_system(spark, path)
    return files.exists(root)


def rename(spark: SparkSession, source: str, target: str) -> None:
    files, root = _file_system(spark, source)
    if not files.rename(root, _file_system(spark, target)[1]):
        raise OSError(f"{source} cannot be renamed to {target}")


def delete_folder(spark: SparkSession, path: str) -> None:
    files, root = _file_system(spark, path)
    files.delete(root, True)


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all versions of the views but the `keep` newest published ones, and gives their names. Newer versions that
    are not published yet are left alone."""
    if keep < 1:
        raise ValueError("the current version must stay")
    published = [row.version for row in spark.read.parquet(f"{path}/published").distinct().orderBy(F.col("version").desc()).collect()]
    oldest, gone = published[:keep][-1], set()
    views = [*folders(spark, path), *[f"key_ranges/{name}" for name in folders(spark, f"{path}/key_ranges")]]
    for view in views:
        for folder in folders(spark, f"{path}/{view}"):
            version = folder.removeprefix("version=")
            if folder != version and version < oldest:
                delete_folder(spark, f"{path}/{view}/{folder}")
                gone.add(version)
    return sorted(gone)


def drop_expired_days(spark: SparkSession, path: str, oldest: date) -> list[str]:
    """Deletes the partitions by `alert_date` of a stored live table that lie before `oldest`, and gives their dates."""
    gone = []
    for folder in folders(spark, path):
        day = folder.removeprefix("alert_date=")
        if folder != day and day[:4].isdigit() and day < oldest.isoformat():
            delete_folder(spark, f"{path}/{folder}")
            gone.append(day)
    return gone


def _finish_rewrites(spark: SparkSession, path: str) -> None:
    """Ends what an interrupted `drop_expired` has left: a complete copy takes the place of its day, the rest goes."""
    for folder in folders(spark, path):
        kind, _, rest = folder.partition("-of-")
        day = f"{path}/{rest.partition('-by-')[0]}"
        if kind == "_copy" and exists(spark, f"{path}/{folder}/_SUCCESS") and not exists(spark, day):
            rename(spark, f"{path}/{folder}", day)
        elif kind in ("_copy", "_old"):
            delete_folder(spark, f"{path}/{folder}")


def drop_expired(spark: SparkSession, path: str, oldest: datetime) -> list[str]:
    """Deletes the alerts of a stored live table that were inserted at `oldest` or before, to the microsecond, and gives
    the days that went as a whole.

    Days before are deleted as folders. The day of the bound is copied without its old rows and the copy put in its
    place; readers ignore names that begin with an underscore. Nothing may write into that day meanwhile: at the
    retention's age no stream does. An interrupted run is finished by the next one.
    """
    _finish_rewrites(spark, path)
    gone = drop_expired_days(spark, path, oldest.date())
    name = f"alert_date={oldest.date().isoformat()}"
    if not exists(spark, f"{path}/{name}"):
        return gone
    day = spark.read.parquet(f"{path}/{name}")
    bound = F.lit(oldest.isoformat(" ")).cast("timestamp")
    if day.filter(F.col("inserted_at") <= bound).isEmpty():
        return gone
    run = uuid.uuid4().hex
    copy, old = f"{path}/_copy-of-{name}-by-{run}", f"{path}/_old-of-{name}-by-{run}"
    day.filter(F.col("inserted_at") > bound).write.parquet(copy)
    rename(spark, f"{path}/{name}", old)
    rename(spark, copy, f"{path}/{name}")
    delete_folder(spark, old)
    return gone


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Stores a table in `buckets` by a hash of `key`, sorted in each, so that joins and groupings by it need no shuffle.

    Tables that are joined need the same number of buckets. One task writes a bucket, so a key's rows must fit in one.
    """
    spark = df.sparkSession
    table = f"stored_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay: the table is an external one
    note = spark.createDataFrame([(key, buckets, df.schema.json())], "bucket_key string, buckets int, columns string")
    note.coalesce(1).write.mode("overwrite").parquet(f"{path}-layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of `write_bucketed` with its buckets known to the planner; in any session, whatever its catalog."""
    note = spark.read.parquet(f"{path}-layout").first()
    columns = T.StructType.fromJson(json.loads(note["columns"]))
    table = f"bucketed_{uuid.uuid4().hex}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    spark.sql(
        f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY (`{note['bucket_key']}`) "
        f"SORTED BY (`{note['bucket_key']}`) INTO {note['buckets']} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)
