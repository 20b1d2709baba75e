"""Row keys, names that don't clash, and bit maps that keep rows without a match out of shuffles."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key of a bit map: with two marks a key, about one other key in 70 passes.
BITS_PER_KEY = 16
#: Bytes of a bit map at most.
MOST_BYTES = 8 << 20


def named(column: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col(f"`{column.replace('`', '``')}`")


def spare(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores as it takes to clash with none of ``taken``."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def row_key(*columns: Column) -> Column:
    """128 bits that stand for a row's values, as binary.

    A hash goes on from that of the column before, and passes over nulls. So what tells the halves
    apart comes first, or the second would follow from the first; and which columns are null is hashed, too.
    """
    halves = (F.lpad(F.hex(F.xxhash64(F.lit(half), *columns, *(c.isNull() for c in columns))), 16, "0") for half in (0, 1))
    return F.unhex(F.concat(*halves))


def bit_words(hashes: DataFrame, rows: int, bits_per_key: int = BITS_PER_KEY) -> tuple[DataFrame, int]:
    """The 64-bit words of a bit map of the only column of ``hashes`` (long), one array in one row, and its bits.

    Two bits are marked for each of ``rows`` hashes. Words are made by a map-side
    combined ``bit_or``: the array's size is
    known before it is made, ``MOST_BYTES`` at most, and keys never reach the
    driver. A full map lets more other keys pass, and none of its own fail.
    """
    bits = 1 << min(max(10, (max(1, rows) * bits_per_key - 1).bit_length()), (8 * MOST_BYTES).bit_length() - 1)
    h = F.col(f"`{hashes.columns[0]}`")
    places = hashes.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("place"))
    marks = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    whole = hashes.sparkSession.range(bits // 64).join(marks, F.col("id") == F.col("at"), "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x.word).alias("words")), bits


def bit_map(hashes: DataFrame, rows: int, bits_per_key: int = BITS_PER_KEY) -> tuple[Column, int]:
    """:func:`bit_words` as a scalar subquery, for :func:`marked` outside of higher-order functions."""
    words, bits = bit_words(hashes, rows, bits_per_key)
    return words.scalar(), bits


@contextlib.contextmanager
def variable(row: DataFrame) -> Iterator[Column]:
    """The only value of ``row`` as a constant, which higher-order functions take, too: a session variable while it is in use."""
    spark, name = row.sparkSession, f"lakemill_{uuid.uuid4().hex}"
    row.createOrReplaceTempView(name)
    spark.sql(f"declare variable {name} {row.schema[0].dataType.simpleString()}")
    try:
        spark.sql(f"set variable {name} = (select * from {name})")
        yield F.expr(f"session.{name}")
    finally:
        spark.sql(f"drop temporary variable {name}")
        spark.catalog.dropTempView(name)


def marked(found: tuple[Column, int], h: Column) -> Column:
    """Whether the hash ``h`` may be one of those that ``found`` was made of; never false for one of them."""
    words, bits = found
    at = lambda place: F.call_function("shiftright", F.get(words, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return at(h.bitwiseAND(F.lit(bits - 1))) & at(F.shiftright(h, 32).bitwiseAND(F.lit(bits - 1)))


def _met(rows: DataFrame, keys: DataFrame, of: list[str], key: str) -> tuple[DataFrame, Column]:
    """``rows`` with their row key over the columns ``of`` as ``key``, and whether a bit map lets it pass for one of ``keys``."""
    found = bit_map(keys.select(F.xxhash64("rkey").alias("h")).distinct(), keys.count())
    return rows.withColumn(key, row_key(*(named(c) for c in of))), marked(found, F.xxhash64(key))


def within(rows: DataFrame, keys: DataFrame, of: list[str], key: str) -> DataFrame:
    """``rows`` whose row key over the columns ``of`` is in ``keys`` (a written table with a binary column ``rkey``), with the key as ``key``.

    Rows that miss a bit map of the keys don't move; the few others meet the keys in a join.
    """
    keyed, hit = _met(rows, keys, of, key)
    return keyed.where(hit).join(keys.select(F.col("rkey").alias(key)).distinct(), key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, of: list[str]) -> DataFrame:
    """``rows`` whose row key over the columns ``of`` isn't in ``keys`` (a written table with a binary column ``rkey``).

    Rows that miss a bit map of the keys stay where they are; the few others
    meet the keys in a join.
    """
    columns, key = [named(c) for c in rows.columns], spare("rkey", rows.columns)
    keyed, hit = _met(rows, keys, of, key)
    left = keyed.where(hit).join(keys.select(F.col("rkey").alias(key)).distinct(), key, "left_anti")
    return keyed.where(~hit).select(columns).unionByName(left.select(columns))
