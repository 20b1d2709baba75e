"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.llm.storage import cut


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based rank of each row in its group, as a long column ``name``.

    ``bucket`` is a whole number that never falls along ``order``. Rows are
    ranked within (group, bucket), and the counts of a group's earlier buckets
    are added; so a task holds one bucket at a time, and a hot group only has
    more rows in each of its buckets.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = [c for c in df.columns if c != name]
    return keyed.withColumn("_inside", inside).join(starts, same).select(*own, (F.col("_start") + F.col("_inside")).cast("long").alias(name))


def sort_ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the 0-based rank of each row in its group, as a long column ``name``, whatever share of the rows a group, or a tie, has.

    Rows are dealt out by ranges of ``group`` and ``order``, whose columns
    together tell rows apart, and written; they are ranked within (range,
    group), and the counts of a group's earlier ranges are added. A group of any
    size is spread over as many ranges as it fills, and what is summed for it is one row for each.
    """
    placed = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.withColumn("_inside", inside).join(starts, same).select(*df.columns, (F.col("_start") + F.col("_inside")).cast("long").alias(name))


def repeats(rows: DataFrame, key: str, row: str, name: str) -> DataFrame:
    """(``key``, ``row``, ``name``) of the rows whose ``key`` others have too: ``name`` counts them from 0.

    ``row`` is what ``monotonically_increasing_id`` gave, in a written table.
    Which of equal rows gets which number depends on the layout, the numbers
    don't. A key that many rows have is ranked partition by partition.
    """
    again = rows.groupBy(key).agg(F.count("*").alias("_k")).where("_k > 1").select(key)
    return ranked(rows.join(again, key, "left_semi"), [key], F.shiftright(row, 33), [F.col(row)], name)
