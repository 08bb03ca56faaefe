"""Places of rows in a total order, counted without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netsentry.llm.common import free_name, shuffle_width, stored


def ranked(rows: DataFrame, group: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """Adds `rank` (bigint, from 0, by `order` ascending with nulls first, within the columns `group`) and `size`, the
    rows of the group. Nulls of a group column are one group. Rows that tie in all of `order` come in any order, but
    get different ranks; equal rows are interchangeable. An empty table gives no rows.

    Rows are range-partitioned by group and order, sorted and stored; a row's place in its partition and the counts of
    the partitions before (one row per partition and group) give its rank. So a group that holds most rows is spread
    over many partitions.
    """
    names = [free_name(rows, n) for n in ("ranked_part", "ranked_place", "ranked_salt")]
    part, place, salt = names
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    # Rows that tie are dealt out by the salt, as a value that very many share would fill one partition otherwise.
    salted = rows.withColumn(salt, F.monotonically_increasing_id())
    placed = (
        salted.repartitionByRange(shuffle_width(rows.sparkSession), *keys, F.col(salt))
        .sortWithinPartitions(*keys, F.col(salt))
        .drop(salt)
        .withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = stored(placed, "ranked")
    counts = placed.groupBy(*group, part).agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("rows"))
    whole = W.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(whole.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(
        *(F.col(c).alias(f"of_{k}") for k, c in enumerate(group)),
        F.col(part).alias("of_part"),
        (before - F.col("least")).alias("shift"),
        F.sum("rows").over(whole).alias("whole"),
    )
    here = F.lit(True)
    for k, c in enumerate(group):
        here &= placed[c].eqNullSafe(counts[f"of_{k}"])
    joined = placed.join(counts, here & (placed[part] == counts["of_part"]))
    return joined.select(
        *(placed[c] for c in rows.columns), (placed[place] + counts["shift"]).alias(rank), counts["whole"].alias(size)
    )
