"""Column functions; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is zero."""
    return F.try_divide(a, b)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1))


def tokens(text: Column) -> Column:
    """How many runs of characters white space parts; 0 for empty and null texts."""
    return F.when(F.trim(text) == "", 0).otherwise(F.coalesce(F.size(F.split(F.trim(text), r"\s+")), F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
