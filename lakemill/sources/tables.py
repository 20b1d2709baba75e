"""Tables in a folder of Parquet, and other files that can be read and written."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Formats with a schema of their own; the others are read with one that is given, so no pass infers it.
SELF_DESCRIBING = ("parquet", "orc")
FORMATS = (*SELF_DESCRIBING, "csv", "json", "xml", "text")
#: Formats of which a task reads files whole, and rows that a file of them gets at most.
WHOLE, ROWS_OF_FILE = ("xml",), 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Read files; formats that don't describe themselves need a schema, but for text."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if schema is None and fmt not in (*SELF_DESCRIBING, "text"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write files, in folders by the values of ``partition_by``, which readers can prune.

    Rows of a partition are brought together first, so that each task doesn't
    write a file for each of them; large partitions are split by adaptive plans. What a
    reader can't split (:data:`WHOLE`) is written as files of a bounded number of rows.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    keys = list(partition_by)
    rows = df.hint("rebalance", *keys) if keys else df
    if fmt in WHOLE:
        options = {"maxRecordsPerFile": str(ROWS_OF_FILE), **options}
    rows.write.format(fmt).options(**options).mode(mode).partitionBy(*keys).save(path)


def binary(spark: SparkSession, path: str, pattern: str = "*", least_bytes: int = 0, most_bytes: int | None = None, since: datetime.datetime | None = None) -> DataFrame:
    """Files as rows: ``path``, ``modificationTime``, ``length``, ``content``, and what folders are named by.

    Files are chosen by name (``pattern``), length and time (changed at ``since`` or later) from
    their listing; the content of others is never read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    found = found.where(F.col("length") >= least_bytes)
    if most_bytes is not None:
        found = found.where(F.col("length") <= most_bytes)
    return found.where(F.col("modificationTime") >= F.lit(since)) if since is not None else found
