"""User functions that built-ins don't cover, by Arrow batches rather than row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Different values that a task counts before it sends what it has.
MOST_COUNTED = 100_000


@F.pandas_udf(DoubleType())
def clipped_mean(values: pd.Series) -> float:
    """The mean without the lowest and highest tenth: a grouped aggregate."""
    values = values.dropna().sort_values()
    cut = len(values) // 10
    kept = values.iloc[cut : len(values) - cut]
    return float(kept.mean()) if len(kept) else float("nan")


@F.arrow_udf(StringType())
def title(text: pa.Array) -> pa.Array:
    """Each word with a capital and small letters after it."""
    return pc.utf8_title(text)


@F.arrow_udtf(returnType=StructType([StructField("position", IntegerType()), StructField("word", StringType())]))
class Words:
    """A table function of a table: the words of the texts in its first column, between white space, and their places; by Arrow batches."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        texts = pc.utf8_trim_whitespace(pc.fill_null(rows.column(0), ""))
        lists = pc.split_pattern_regex(texts, pattern=r"\s+")
        words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        places = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.table({"position": pa.array(places, pa.int32()), "word": words}).filter(pc.not_equal(words, ""))


@F.pandas_udf(StringType())
def initials(names: pd.Series) -> pd.Series:
    """The first letters of the words of each name: a scalar function over pandas series."""
    return names.str.findall(r"(?:^|\s)(\S)").str.join("")


class Bands:
    """Edges of price bands; stands for a model that takes long to load."""

    loaded = 0

    def __init__(self, width: float, bands: int):
        Bands.loaded += 1
        self.edges = np.arange(1, bands) * width

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, values, side="right")


def banded(width: float, bands: int) -> Callable[[Column], Column]:
    """A function of a number: its band. What it needs is loaded once for each task, not for each batch."""

    @F.pandas_udf(LongType())
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Bands(width, bands)
        for values in series:
            yield pd.Series(model.of(values.to_numpy(dtype=float, na_value=np.nan)), index=values.index).where(values.notna())

    return run


def demeaned(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each value less its key's mean; a null key is a key like others.

    Means are made map-side first and joined to the rows, so that a key's rows are never gathered.
    """
    means = df.groupBy(F.col(key).alias("_key")).agg(F.avg(value).alias("_mean"))
    met = df.join(means, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn(value, F.col(value) - F.col("_mean")).select(*df.columns)


def shares_within(df: DataFrame, key: str, value: str, share: str, bucket_rows: int = 50_000) -> DataFrame:
    """Adds each value's share of its key's total, by grouped map: for keys that have few rows by nature, such as the lines of an order.

    A group holds the keys of one bucket, about ``bucket_rows`` rows, as a call for each key would cost more than its work. Null keys are one key.
    """
    buckets = max(1, -(-df.count() // bucket_rows))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{share: rows[value] / rows.groupby(key, dropna=False)[value].transform("sum")})

    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(buckets))).applyInPandas(run, StructType([*df.schema, StructField(share, DoubleType())]))


def running_counts(df: DataFrame, column: str) -> DataFrame:
    """Value counts, made for each partition in one pass over its batches and then added up.

    A task holds :data:`MOST_COUNTED` values and those of a batch at most, and sends what it has then.
    """
    kind = to_arrow_type(df.schema[column].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        given = lambda: pa.RecordBatch.from_arrays([pa.array(list(totals), kind), pa.array(list(totals.values()), pa.int64())], [column, "n"])
        for batch in batches:
            for pair in batch.column(column).value_counts().to_pylist():
                totals[pair["values"]] = totals.get(pair["values"], 0) + pair["counts"]
            if len(totals) >= MOST_COUNTED:
                yield given()
                totals.clear()
        yield given()

    counted = df.select(column).mapInArrow(run, f"`{column}` {df.schema[column].dataType.simpleString()}, n long")
    return counted.groupBy(column).agg(F.sum("n").alias("n"))
