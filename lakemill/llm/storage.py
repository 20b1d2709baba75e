"""Intermediate tables, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakemill.sources.scratch import cut, drop, shared_dir

__all__ = ["cut", "drop", "shared_dir", "shuffled", "tasks"]

#: Rows of a comparison that a task gets, about: they are few and take long, so size isn't a guide.
ROWS_OF_TASK = 20_000


def tasks(df: DataFrame) -> int:
    """How many tasks a comparison of the rows of ``df``, a written table, is dealt to."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_OF_TASK))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, which Spark is to shuffle and sort.

    Left alone it sends a side to all tasks, by way of the driver, once its guess at the size is small, and it
    takes an array for one element and a written table for as small as its compressed files.
    """
    return df.hint("merge")
