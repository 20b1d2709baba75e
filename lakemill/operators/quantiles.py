"""Exact quantiles of groups of any size: values are found by counting ranges, narrower each round."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from lakemill.sources.scratch import cut, drop

#: Bits of a value that a round settles: four rounds settle a double, and a round counts 2 ** 16 ranges at most for each range that is left.
ROUND_BITS = 16
#: Turns the bits of negative numbers round.
ALL_BUT_SIGN = (1 << 63) - 1


@F.arrow_udf(LongType())
def _ordered(values: pa.Array) -> pa.Array:
    """A whole number for each double, in the same order; a NaN is above all numbers, and both zeros are one."""
    bits = pc.if_else(pc.is_nan(values), float("nan"), pc.add(values, 0.0)).view(pa.int64())
    return pc.if_else(pc.less(bits, 0), pc.bit_wise_xor(bits, ALL_BUT_SIGN), bits)


@F.arrow_udf(DoubleType())
def _value(bits: pa.Array) -> pa.Array:
    """The double that :func:`_ordered` made a number of."""
    return pc.if_else(pc.less(bits, 0), pc.bit_wise_xor(bits, ALL_BUT_SIGN), bits).view(pa.float64())


def _same(names: list[str]) -> Column:
    """Whether the keys of ``f`` and ``c`` are equal; nulls are."""
    return reduce(and_, (F.col(f"f.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names), F.lit(True))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, between: dict[str, float] | None = None, at_row: dict[str, float] | None = None) -> DataFrame:
    """Quantiles of ``value`` (as double) for each key: ``keys``, ``n`` (values that aren't null), and a column for each name.

    ``between={"median": 0.5}`` adds ``median``, at place ``p * (n - 1)`` of the
    ``n`` values in order, counted from 0, between the two nearest rows; ``at_row`` takes the value of row ``ceil(p * n) - 1``. Nulls
    don't count; a key without values has nulls; a null key is a key like others; a NaN is above all numbers; an empty table gives no rows.

    Spark's own functions put all distinct values of a group into a map in one task.
    Here no value is shuffled: a round counts, map-side first, how many rows of a key lie in each
    range of values, finds the range of each row sought, and leaves only the rows in
    such a range to the next round, which parts it into 65,536; four settle all bits of a double. What a
    task gets are counts. For many small groups Spark's own functions are the better choice.
    """
    between, at_row = between or {}, at_row or {}
    if bad := [p for p in [*between.values(), *at_row.values()] if not 0 <= p <= 1]:
        raise ValueError(f"not between 0 and 1: {bad}")
    names = [f"k{i}" for i in range(len(keys))]
    rows = cut(df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), _ordered(F.col(value).cast("double")).alias("x")), "values")
    # of rows without keys there is one group, even if it's empty
    sizes = cut(rows.groupBy(*names).agg(F.count("x").alias("n")), "sizes")
    spots = {name: F.lit(p) * (F.col("n") - 1) for name, p in between.items()}
    low, high = ({name: f(spot).cast("long") for name, spot in spots.items()} for f in (F.floor, F.ceil))
    exact = {name: F.greatest(F.lit(0), F.ceil(F.lit(p) * F.col("n")) - 1).cast("long") for name, p in at_row.items()}
    places = F.array(*low.values(), *high.values(), *exact.values())
    # top: the bits that are settled; before: how many rows of the key are below them
    found = cut(sizes.where("n > 0").select(*names, F.explode(F.array_distinct(places)).alias("place")).select("*", F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("before")), "sought")
    rows = rows.where("x is not null")
    for shift in range(64 - ROUND_BITS, -1, -ROUND_BITS):
        first, last = shift == 64 - ROUND_BITS, shift == 0
        part = F.shiftright("x", shift)
        counts = rows.groupBy(*names, part.alias("range")).agg(F.count("*").alias("n")).withColumn("above", F.lit(0).cast("long") if first else F.shiftright("range", ROUND_BITS))
        lower = Window.partitionBy(*names, "above").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("under", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        met = found.alias("f").join(summed.alias("c"), _same(names) & (F.col("f.top") == F.col("c.above")))
        ahead = F.col("place") - F.col("before") - F.col("under")
        settled = met.where((ahead >= 0) & (ahead < F.col("c.n"))).select(*(F.col(f"f.{n}").alias(n) for n in names), "place", F.col("range").alias("top"), (F.col("before") + F.col("under")).alias("before"))
        settled = cut(settled, "sought")
        drop(found)
        found = settled
        if not last:
            ranges = found.select(*names, "top").distinct()
            fewer = cut(rows.withColumn("part", part).alias("f").join(ranges.alias("c"), _same(names) & (F.col("f.part") == F.col("c.top")), "left_semi").drop("part"), "values")
            drop(rows)
            rows = fewer
    drop(rows)
    # as many values for a key as quantiles are asked for
    values = found.withColumn("v", _value(F.col("top"))).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    both = sizes.alias("f").join(values.alias("c"), _same(names), "left").select("f.*", "m")
    get = lambda place: F.try_element_at("m", place)
    out = {name: F.when(low[name] == high[name], get(low[name])).otherwise(get(low[name]) + (get(high[name]) - get(low[name])) * (spots[name] - low[name])) for name in between}
    out |= {name: get(place) for name, place in exact.items()}
    return both.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "n", *(c.alias(name) for name, c in out.items()))
