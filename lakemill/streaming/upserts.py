"""Upserts from a stream: batches as folders, merged into larger ones level by level, so that readers open few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lakemill.operators.groups import latest_per_key

#: The column in which files say which batch a row came with.
BATCH = "_batch"


class Levels:
    """Folders under ``path``, named by level and last batch: ``every`` folders of a level become one of the next.

    A folder counts once Spark has marked it as complete, so what a failed job left is never read,
    and a batch that is written again writes the same folders again.
    """

    def __init__(self, spark: SparkSession, path: str, every: int):
        if every < 2:
            raise ValueError("at least two folders are merged into one")
        self.spark, self.path, self.every = spark, path, every
        self.place = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, level: int, last: int) -> str:
        return f"{self.path}/level{level}-upto{last}"

    def complete(self, folder: str) -> bool:
        return self.fs.exists(self.place(f"{folder}/_SUCCESS"))

    def last(self) -> int:
        """The last batch that a complete folder holds; -1 if there is none."""
        if not self.fs.exists(self.place(self.path)):
            return -1
        names = [str(s.getPath().getName()) for s in self.fs.listStatus(self.place(self.path))]
        return max((int(n.rsplit("upto", 1)[1]) for n in names if n.startswith("level") and self.complete(f"{self.path}/{n}")), default=-1)

    def covering(self, last: int) -> list[str]:
        """The fewest complete folders that hold all batches up to ``last``."""
        out, start = [], 0
        while start <= last:
            level = 0
            while start % self.every ** (level + 1) == 0 and start + self.every ** (level + 1) - 1 <= last:
                level += 1
            while level and not self.complete(self.folder(level, start + self.every**level - 1)):
                level -= 1
            folder = self.folder(level, start + self.every**level - 1)
            if self.complete(folder):
                out.append(folder)
            start += self.every**level
        return out

    def add(self, batch: DataFrame, number: int, keys: list[str]) -> None:
        """Write a batch, and merge what is complete with it."""
        batch.dropDuplicates(keys).withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(self.folder(0, number))
        size = self.every
        level = 1
        while (number + 1) % size == 0:
            parts = [self.folder(level - 1, last) for last in range(number - size + size // self.every, number + 1, size // self.every)]
            found = [p for p in parts if self.complete(p)]
            if found:
                rows = self.spark.read.schema(StructType([*batch.schema, StructField(BATCH, LongType())])).parquet(*found)
                latest_per_key(rows, keys, [BATCH]).write.mode("overwrite").parquet(self.folder(level, number))
            # readers may still be at the folders just merged; those of the group before go
            for last in range(number - 2 * size + size // self.every, number - size + 1, size // self.every):
                if last >= 0 and self.complete(self.folder(level, number - size)):
                    self.fs.delete(self.place(self.folder(level - 1, last)), True)
            size, level = size * self.every, level + 1


def upsert_to(df: DataFrame, path: str, keys: list[str], checkpoint: str, mode: str = "append", every: int = 10) -> StreamingQuery:
    """Write all that a stream has by batches, of which :func:`upserted` takes each key's last row; returns when it has ended.

    Every ``every`` batches become one folder, and every ``every`` of these one of the next level: a row is
    written again as often as there are levels, and a reader opens fewer than ``every`` folders of
    each. Of a batch's rows of one key any one is taken; null keys are keys like others.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        Levels(spark, path, every).add(batch, number, keys)

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upserted(spark: SparkSession, path: str, schema: StructType, keys: list[str], every: int = 10) -> DataFrame:
    """What :func:`upsert_to` wrote, each key with the row of the last batch that has it; nothing if there is no batch. ``every`` as it was given there."""
    levels = Levels(spark, path, every)
    found = levels.covering(levels.last())
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema, StructField(BATCH, LongType())])).parquet(*found)
    return latest_per_key(rows, keys, [BATCH]).drop(BATCH)
