"""Streaming operators on event tables, with watermarks."""

from __future__ import annotations

import contextlib
import threading
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lakemill.operators.groups import latest_per_key


def source(spark: SparkSession, path: str, time: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet table's files; the time is cast to one that watermarks take."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # streams watch folders: a table of one file is its folder, without the rest
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count and sum for each window and key; ``slide`` makes windows overlap, ``late`` sets the watermark."""
    rows = events.withWatermark(time, late) if late else events
    windowed = rows.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys)
    return windowed.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def session_windows(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Count for each session of a key: events at most ``gap`` apart."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def deduplicate(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key; state older than the watermark is let go."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Pairs of one key in which the right event follows within ``within``; other columns have to differ."""
    a = left.withWatermark(left_time, late).alias("a")
    b = right.withWatermark(right_time, late).alias("b")
    after = F.col(f"b.{right_time}").between(F.col(f"a.{left_time}"), F.col(f"a.{left_time}") + F.expr(f"interval {within}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & after)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Count and sum of each key so far, after each batch that has it (mode "update"); values that are null or NaN count as rows and add nothing.

    Rows are added up map-side, and a key's state is its two numbers: nothing is called for each key.
    """
    total = F.sum(F.nanvl(F.col(value).cast("double"), F.lit(0.0)))
    return events.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0.0)).alias("total"))


class Dropped(StreamingQueryListener):
    """Counts, for each run of a stream, the rows that came behind the watermark and were dropped."""

    def __init__(self):
        self.rows: Counter[str] = Counter()
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.news:
            self.rows[str(event.progress.runId)] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, query: StreamingQuery, seconds: float = 60) -> int:
        """What the run of ``query``, which has ended, dropped; waits until its last news have come."""
        run = str(query.runId)
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"no end of run {run} in {seconds} seconds")
            return self.rows[run]


@contextlib.contextmanager
def dropped_rows(spark: SparkSession) -> Iterator[Dropped]:
    """A counter of late rows while streams run."""
    counter = Dropped()
    spark.streams.addListener(counter)
    try:
        yield counter
    finally:
        spark.streams.removeListener(counter)


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run all that is there into the in-memory table ``name``, and end."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batches_to(df: DataFrame, path: str, keys: list[str], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write each batch as Parquet into a folder of its own, so that a batch written twice counts once.

    Keys are made unique within a batch (without ``keys``, all rows are written); one that comes in two batches is in both
    folders, of which :func:`merged` takes the later.
    """

    def write(batch: DataFrame, number: int) -> None:
        (batch.dropDuplicates(keys) if keys else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def merged(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """What :func:`batches_to` wrote, each key with the row of the last batch that has it: an upsert, merged when it is read.

    Rows are combined map-side before they are shuffled. Null keys are keys like others.
    """
    found = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    return latest_per_key(found, keys, ["batch"]).drop("batch")
