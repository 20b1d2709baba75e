"""Shards that each hold the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.keys import named
from lakemill.llm.ranking import ranked, repeats
from lakemill.llm.storage import cut


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal all rows into ``shards`` shards, each with the mixture of sources, counts at most one apart.

    Rows are shuffled by a seeded hash and ranked within their source; sorted by
    fractional rank, (rank + phase) / rows of the source, all sources advance at
    their own rates, so each run of rows has the mixture of the whole, and the
    sorted rows are cut into equal runs. The phase, in [0, 1), is drawn by seed and source, so that the rows of many
    small sources are spread over all shards, too. The law is ``rows``: texts equal to
    each other are dealt out like others.

    Returns ``id_col``, ``size`` (bytes of the text and 1), ``text_crc32``,
    ``law``, ``shard``, ``slot`` (gapless from 0 in a shard) and ``grown_shard``
    (null). Null and empty texts have size 1 and checksum 0; a null source is a
    source; rows equal in id, source and text are numbered among themselves, so that the
    seed and the rows fix the result, whatever their layout;
    other columns are ignored, whatever their names; an empty table gives no rows.

    The hash is the first 60 bits of an MD5, which other engines have too.
    No text is shuffled. Ranks come from buckets of the hash, then of the
    fractional rank, as many as the square root of the number of rows, so that
    neither a source with a third of all rows nor the whole is sorted by one task.
    What they need of each row is written once, so that it never changes.
    """
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    # null isn't the empty string, and no two rows that differ are numbered together
    marked = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit(""))
    origin = marked(named(source_col))
    digest = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
    base = docs.select(
        named(id_col).alias("id"), named(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        digest(F.lit(seed), F.coalesce(named(id_col).cast("string"), F.lit("")), origin, text).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    base = cut(base, "shard-keys")
    nth = repeats(base.select("key", "row"), "key", "row", "nth")
    again = F.when(F.col("nth") > 0, digest(F.col("key"), F.col("nth"))).otherwise(F.col("key"))
    base = base.join(nth, ["key", "row"], "left").select("id", "source", "size", "text_crc32", again.alias("hash"))
    base = cut(base, "shard-rows")
    rows = max(1, base.count())
    buckets = math.isqrt(rows) + 1
    # the bucket rises with the hash: it is the interval that the hash's high bits lie in
    interval = F.floor(F.shiftright("hash", 30) * buckets / 2**30)
    # equal hashes of rows that differ are told apart by what they hold
    order = [F.col(c) for c in ("hash", "id", "text_crc32", "size")]
    first = ranked(base, ["source"], interval, order, "rank")
    totals = base.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("total"))
    phase = digest(F.lit(seed), F.lit("source"), marked(F.col("source"))).cast("double") / 2.0**60
    parts = first.join(totals, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", (F.col("rank") + phase) / F.col("total"))
    parts = parts.select("id", "size", "text_crc32", "hash", "source", "part", F.lit(0).alias("all"))
    placed = ranked(parts, ["all"], F.floor(F.col("part") * buckets), [F.col("part"), F.col("source"), *order], "place")
    dealt = placed.withColumn("shard", F.expr(f"place * {shards}L div {rows}L"))
    return dealt.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        # a shard begins at the least place that is cut into it
        F.expr(f"place - (shard * {rows}L + {shards - 1}L) div {shards}L").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
