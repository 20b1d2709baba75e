"""Operators on groups of rows: top rows, latest rows, sessions, gaps, distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with ``rank`` from 1.

    Spark drops rows beyond ``k`` before it shuffles (a window group limit).
    """
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the greatest ``version`` columns, by a map-side combined maximum; no sort."""
    rest = [c for c in df.columns if c not in {*keys, *version}]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*version, *rest), F.struct(*version, *rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def sessions(df: DataFrame, key: str, time: str, gap: str, order: list[str] | None = None) -> DataFrame:
    """Add ``session``, numbered from 0 in each key: a new one begins when more than ``gap`` passed since the row before.

    All rows of a key are one task's, which sorts and spills them.
    """
    along = Window.partitionBy(key).orderBy(time, *(order or []))
    new = (F.col(time) > F.lag(time).over(along) + F.expr(f"interval {gap}")).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(along)).drop("_new")


def stretch(time: str, length: str) -> Column:
    """The number of the stretch of time, ``length`` long (an interval such as "1 day" or "90 minutes"), that a timestamp or date is in."""
    moment = F.col(time).cast("timestamp")
    size = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp") + F.expr(f"interval {length}")) - F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return F.floor(F.unix_micros(moment) / size).cast("long")


def sessions_by_time(df: DataFrame, key: str, time: str, gap: str, bucket: str) -> DataFrame:
    """:func:`sessions` for keys of any size: rows of a key are dealt out by stretches of time, ``bucket`` long (such as "1 day").

    A stretch learns from the one before only when that ended, and from all before how many
    sessions began in them: a row for each key and stretch. Rows of equal key and time are in one
    session; rows without a time get none.
    """
    known = df.withColumn("_bucket", stretch(time, bucket))
    moments = known.groupBy(key, "_bucket").agg(F.min(time).alias("_a"), F.max(time).alias("_z")).where("_bucket is not null")
    along = Window.partitionBy(key).orderBy("_bucket")
    wait = F.expr(f"interval {gap}")
    inside = Window.partitionBy(key, "_bucket").orderBy(time)
    # new sessions within a stretch; whether its first row begins one is for the stretches to say
    rows = known.withColumn("_new", F.coalesce((F.col(time) > F.lag(time).over(inside) + wait).cast("long"), F.lit(0))).withColumn("_inner", F.sum("_new").over(inside))
    begun = rows.where("_bucket is not null").groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_b")).agg(F.sum("_new").alias("_n"))
    opens = moments.withColumn("_open", F.coalesce((F.col("_a") > F.lag("_z").over(along) + wait).cast("long"), F.lit(0))).select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), "_open")
    order = Window.partitionBy("_key").orderBy("_b")
    whole = opens.join(begun, F.expr("true") & opens["_key"].eqNullSafe(begun["_key"]) & (opens["_b"] == begun["_b"])).select(opens["_key"], opens["_b"], "_open", "_n")
    started = whole.withColumn("_before", F.sum(F.col("_open") + F.col("_n")).over(order) - F.col("_n")).select("_key", "_b", "_before")
    met = rows.join(started, rows[key].eqNullSafe(started["_key"]) & (rows["_bucket"] == started["_b"]), "left")
    return met.select(*(rows[c] for c in df.columns), (F.col("_before") + F.col("_inner")).alias("session"))


def fill_days(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """One row for each key and day between its first and last, ``value`` carried on over days without a row.

    ``df`` has one row for each key and day at most.
    """
    span = df.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    carried = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.join(df.select(key, day, value), [key, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(carried))


def distinct_per_key(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact distinct counts: pairs are made distinct map-side first, so a hot key brings each value once."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(name))


def transposed(df: DataFrame, index: str, most: int = 1000) -> DataFrame:
    """Rows as columns: a row for each column of ``df`` but ``index``, named in ``key``, and a column for each value of ``index``.

    Other columns have to be of one type. The values of ``index``, which become names, are all that
    the driver sees, ``most`` at most; cells are moved by a pivot. Of several rows of one value the greatest cell counts.
    """
    names = sorted(r[0] for r in df.select(F.col(index).cast("string")).where(F.col(index).isNotNull()).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    cells = df.select(F.col(index).cast("string").alias("_name"), *(c for c in df.columns if c != index)).unpivot("_name", None, "key", "_cell")
    return cells.groupBy("key").pivot("_name", names).agg(F.max("_cell"))
