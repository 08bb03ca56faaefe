"""Top-k over a whole table and per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Units of time by which the newest rows are narrowed. Fewer than `n` rows lie after the hour found, so the seconds to count
#: are at most `n` and the 3,600 of that hour.
NARROWING = ("hour", "second")


def _cutoff(df: DataFrame, time: str, unit: str, n: int) -> DataFrame:
    """One row, `cutoff`: the latest start of a unit from which on at least `n` rows lie, null if there are fewer."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(F.date_trunc(unit, time).alias("start")).agg(F.count("*").alias("n"))
    # A row per unit; below the hour only units after the last cut-off are left, about `n` at most.
    so_far = F.sum("n").over(Window.orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.withColumn("so_far", so_far).filter(F.col("so_far") >= n).agg(F.max("start").alias("cutoff"))


def newest(
    df: DataFrame, n: int, times: Sequence[str], tie: Sequence[str] = (), last: Sequence[str] = (), buckets: int = 32
) -> DataFrame:
    """The `n` rows that are last by `times` and `last`, ties in the order of `tie`; for an `n` too large to keep per task.

    Where the first of `times` is a timestamp, it is narrowed first: rows are counted by hour, from the hour found on by
    second, and only rows from that second on reach the sort, by a plain comparison that the
    files' reader gets. The rows left are cut in three steps like those of a key in `top_per_key`, so that one second may
    hold most of the rows. `df` is read once for each step: give a stored table.
    """
    if isinstance(df.schema[times[0]].dataType, T.TimestampType):
        for unit in NARROWING:
            cutoff = _cutoff(df, times[0], unit, n).scalar()
            df = df.filter(cutoff.isNull() | (F.col(times[0]) >= cutoff))
    order = [*[F.col(name).desc() for name in (*times, *last)], *[F.col(name) for name in tie]]
    place = F.row_number().over(Window.partitionBy(F.spark_partition_id() % buckets).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place").orderBy(*order).limit(n)


def top_per_key(
    df: DataFrame, key: str, order: Sequence[Column], n: int | None, position: str = "position", buckets: int = 32
) -> DataFrame:
    """The first `n` rows of each key in the given order, numbered from 1 in `position`; all rows if `n` is None.

    Each task first keeps `n` rows per key, then each of `buckets` groups of tasks, then the key as a whole. A key
    that owns a third of the table is so cut down in parallel: the last step sees at most `buckets * n` of its rows,
    and no task emits more than `n`. (Buckets by a hash of the row would not do: every task would emit `n` rows for
    each bucket.) Any assignment of rows to buckets gives the same result.
    """
    per_bucket = Window.partitionBy(key, "_bucket").orderBy(*order)
    per_key = Window.partitionBy(key).orderBy(*order)
    if n is None:
        return df.withColumn(position, F.row_number().over(per_key).cast("long"))
    return (
        df.withColumn("_bucket", F.spark_partition_id() % buckets)
        .withColumn(position, F.row_number().over(per_bucket))
        .filter(F.col(position) <= n)
        .drop("_bucket")
        .withColumn(position, F.row_number().over(per_key))
        .filter(F.col(position) <= n)
        .withColumn(position, F.col(position).cast("long"))
    )
