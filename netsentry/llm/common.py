"""What the operators share: reading a table, storing a frame in the shared folder, and row keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsentry.plans.store import delete_folder
from netsentry.session import work_dir

#: Separators of words: space and the control characters 9 to 13, as a class of regular expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000

#: Paths of the tables that the open stage has stored, None outside of a stage, and those that the stage before left. Both
#: belong to the thread: pipelines in two threads of one driver do not see each other's tables.
_open: ContextVar[list[str] | None] = ContextVar("open", default=None)
_left: ContextVar[tuple[str, ...]] = ContextVar("left", default=())


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    if (tables := _open.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """A block whose `stored` tables are deleted when the next such block of this thread begins: for stages whose result is
    written before the next stage. Tables stored outside of such blocks stay.

    From then on the session's Arrow batches have BATCH_ROWS rows at most: the default of 10,000 whole texts, held by the
    JVM and by each of its Python workers, is more than a small executor has. A frame is planned when it is written, after
    the block, so the setting outlives it; `settings_kept` around stage and writing puts it back.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    for path in _left.get():
        delete_folder(spark, path)
    tables: list[str] = []
    token = _open.set(tables)
    try:
        yield
    finally:
        _open.reset(token)
        _left.set(tuple(tables))


@contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """A block after which the session's Arrow batch size is what it was before."""
    before = spark.conf.get(BATCH_SETTING)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores before it if the frame has such a column already (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` of the rows, 2 * most at the very most, chosen by a hash of `key`: the same rows on a rerun."""
    count = rows.select(key).count()
    if count <= most:
        return rows
    share = int(most / count * (1 << 31))
    return rows.filter(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 31)) < share).limit(2 * most)
