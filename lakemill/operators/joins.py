"""Joins that Spark SQL has no operator for, from DataFrame operations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakemill.operators.groups import stretch
from lakemill.sources.scratch import cut


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], prefix: str = "") -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides are put in one window per key, in which the last right row is
    carried on: one shuffle, no pairs. A key is one task's, so a hot one needs a
    finer key in ``by``. A left row without a right row before it
    gets nulls; of right rows at one time the one with the greatest values
    counts; null keys match nothing. ``values`` are right columns, named with
    ``prefix`` in the result.
    """
    carried = F.struct(F.col(right_time).alias("_at"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    row = F.struct(*left.columns)
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    b = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_right"))
    keys = [f"_k{i}" for i in range(len(by))]
    seen = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_right", ignorenulls=True).over(seen)).where("_side = 1")
    usable = F.lit(True)
    for k in keys:
        usable &= F.col(k).isNotNull()
    return both.select("_row.*", *(F.when(usable, F.col(f"_found.v{i}")).alias(f"{prefix}{v}") for i, v in enumerate(values)))


def as_of_join_by_time(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], bucket: str, prefix: str = "") -> DataFrame:
    """:func:`as_of_join` for keys of any size: rows of a key are dealt out by stretches of time, ``bucket`` long (such as "1 day").

    A task gets a key's rows of one stretch. What a stretch hands to later ones
    is its last right row, found map-side, and one window over the stretches of a key, a row for each,
    carries it on. Times are timestamps or dates; rows without a time match nothing.
    Otherwise the result is that of :func:`as_of_join`.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    usable = reduce(and_, (F.col(k).isNotNull() for k in keys), F.lit(True))
    row = F.struct(*left.columns)
    carried = F.struct(F.col(right_time).alias("_at"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    named = lambda df: df.select(*(F.col(k).alias(n) for k, n in zip(by, keys, strict=True)), "*")
    a = named(left).select(*keys, stretch(left_time, bucket).alias("_bucket"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    b = named(right).where(F.col(right_time).isNotNull() & usable).select(*keys, stretch(right_time, bucket).alias("_bucket"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_right"))
    seen = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side", F.col("_right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = a.unionByName(b, allowMissingColumns=True).withColumn("_found", F.last("_right", ignorenulls=True).over(seen)).where("_side = 1")
    # every stretch of a key that has rows on either side, with the last right row before it
    ends = b.groupBy(*keys, "_bucket").agg(F.max("_right").alias("_last"))
    stretches = ends.unionByName(a.where(usable & F.col("_bucket").isNotNull()).select(*keys, "_bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    handed = stretches.withColumn("_handed", F.last("_last", ignorenulls=True).over(before)).where("_handed is not null").drop("_last")
    both = inside.join(handed, [*keys, "_bucket"], "left")
    got = F.when(usable & F.col("_t").isNotNull(), F.coalesce("_found", "_handed"))
    return both.withColumn("_got", got).select("_row.*", *(F.col(f"_got.v{i}").alias(f"{prefix}{v}") for i, v in enumerate(values)))


def not_in(left: DataFrame, right: DataFrame, column: str, right_column: str) -> DataFrame:
    """Rows of ``left`` for which SQL's ``column NOT IN (right)`` holds, however large both sides are.

    Three-valued: nothing is known to be outside of a list that holds a null, and a null is known to be outside
    of an empty list only. Spark plans NOT IN with a broadcast of the whole
    list; here two counts of it are taken once, and an anti join does the rest, shuffled by value where the
    list is large. Columns of ``right`` but for the one don't matter.
    """
    listed = right.select(F.col(right_column).alias("_listed"))
    known = listed.agg(F.count("*").alias("n"), F.count("_listed").alias("values"))
    n, values = known.select("n").scalar(), known.select("values").scalar()
    possible = left.where((n == 0) | ((n == values) & F.col(column).isNotNull()))
    return possible.join(listed, F.col(column) == F.col("_listed"), "left_anti")


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Points with the ranges that hold them, start and end included.

    A range is listed under each bucket of ``width`` that it touches and a point
    under its own, so the join has an equality that can be shuffled on and no
    nested loop. Choose ``width`` near the usual length of a range. ``by`` names
    further keys that have to be equal. Columns of both sides have to differ.
    """
    by = by or []
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    a = points.withColumn("_bucket", bucket(point))
    b = ranges.withColumnsRenamed({k: f"_by_{k}" for k in by})
    b = b.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    on: Column = a["_bucket"] == b["_bucket"]
    for k in by:
        on &= a[k] == b[f"_by_{k}"]
    found = a.join(b, on & a[point].between(b[start], b[end]))
    return found.select(*(a[c] for c in points.columns), *(b[c] for c in ranges.columns if c not in by))


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join in which the rows of each key of ``large`` are spread over ``salts`` tasks.

    ``small`` is repeated for each salt; use it where its keys are few rows each
    and a key of ``large`` is hot beyond what adaptive plans split. ``how`` may
    be inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} can't be salted on the large side")
    # by place in a written table, so that rows equal to each other are spread, too, and a task that
    # runs again deals its rows as before; each salt has all of small
    a = cut(large, "salted").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return a.join(b, [on, "_salt"], how).drop("_salt")


def broadcast_join(large: DataFrame, small: DataFrame, large_key: str, small_key: str, most_rows: int = 1_000_000) -> DataFrame:
    """Inner join in which ``small`` is sent to all tasks in parts of about ``most_rows`` rows, so that what the driver holds of it is bounded.

    Rows of a part are those whose keys' hash says so; ``large`` is read once for each part and never shuffled. Keys
    have to be of one type; null keys match nothing. Rows of ``small`` that share one key are one part's.
    """
    parts = max(1, -(-small.count() // most_rows))
    of = lambda df, key, part: df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else df
    return reduce(DataFrame.unionAll, (of(large, large_key, part).join(F.broadcast(of(small, small_key, part)), F.col(large_key) == F.col(small_key)) for part in range(parts)))
