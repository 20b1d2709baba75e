"""Importance resampling towards a target: hashed n-grams by a ring of running checksums, log ratios, Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import slices
from lakemill.llm.keys import named
from lakemill.llm.ranking import sort_ranked
from lakemill.llm.storage import cut, drop

#: What each byte is read as: A to Z in small letters, digits, other letters and bytes above 127 as they are, all else as a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text whose words are listed at once.
STRETCH = 1 << 20


def words(text: bytes) -> Iterator[bytes]:
    """The words of a text in UTF-8, in order."""
    plain, start = text.translate(LETTERS), 0
    while start < len(plain):
        stop = plain.find(b" ", start + STRETCH)
        stop = len(plain) if stop < 0 else stop
        yield from plain[start:stop].split()
        start = stop


def scan(text: bytes, n: int) -> tuple[int, array]:
    """How many words a text has, and the CRC-32 of each run of 1 to ``n`` of them, joined by spaces.

    One pass: a ring keeps the running checksum of the runs that began at each
    of the last ``n`` words. A word begins a run of its own and makes all others
    longer by a space and itself; no run is ever put together.
    """
    ring: list[int] = []
    out, count, crc = array("I"), 0, zlib.crc32
    for word in words(text):
        more = b" " + word
        ring = [crc(word)] + [crc(more, state) for state in ring[: n - 1]]
        out.extend(ring)
        count += 1
    return count, out


def features(docs: DataFrame, buckets: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, ``n_words``, ``buckets``): the buckets of all n-grams of each whole text, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, flat, ends = [], array("I"), array("i", [0])
                for text in part.column("text").cast(pa.binary()):
                    count, found = scan(text.as_py() or b"", n)
                    counts.append(count)
                    flat.extend(found)
                    ends.append(len(flat))
                own = (np.frombuffer(flat, dtype=np.uint32) % np.uint32(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(own))], ["id", "n_words", "buckets"])

    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, buckets array<int>")


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features are in each bucket: counted by partition, then added up; the driver gets one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: a thousand times the smoothed log ratio of target and source, rounded down."""
    size, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + size) / ((s + 1.0) * (all_target + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(``id``, ``n_words``, ``n_features``, ``weight``) of what :func:`features` found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[lists.values.to_numpy()])])
            weight = sums[ends[1:]] - sums[ends[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(np.diff(ends).astype(np.int64)), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def luck(key: Column, seed: int) -> Column:
    """A thousand draws' worth of Gumbel noise, rounded down, fixed by seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, n: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents so that their n-grams are like those of ``target``'s texts, without replacement.

    Features are runs of 1 to ``n`` words, hashed into ``buckets``; a document's
    weight adds up the log ratios of its features, and noise that its id fixes
    makes the highest scores a weighted sample. Returns for each row
    ``id_col``, ``n_features``, ``weight``, ``score`` and ``rank``: 1, 2, 3 ... of those
    drawn by falling score, ties to the smaller id (a null one first), null for all others. Only
    documents of ``least_words`` words or more are drawn, and count towards the number drawn.

    Null and empty texts have no features and a weight of 0, and are never drawn; very
    long ones are read whole, in one pass. Repeated rows count and are ranked each
    on its own; a null id has the noise of an empty one; other columns don't matter. An
    empty target makes all features of a bucket equally strange; an empty table gives no rows.

    Texts are scanned once, for buckets, which are written until they are
    weighed; totals are as many numbers as there are buckets; ranks come from
    ranges of ids and scores.
    """
    found = cut(features(docs, buckets, n, id_col, text_col), "features")
    wanted = totals(features(target.select(F.lit(0).alias("id"), named(target_col).alias("text")), buckets, n, "id", "text"), buckets)
    gain = gains(totals(found, buckets), wanted)
    scored = cut(weighed(found, gain).withColumn("score", F.col("weight") + luck(F.col("id"), seed)), "scores")
    drop(found)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    rows = able.select("*", (-F.col("score")).alias("down"), F.monotonically_increasing_id().alias("row"))
    ranked = sort_ranked(rows, [], ["down", "id", "weight", "n_features", "row"], "place")
    kept = ["n_features", "weight", "score"]
    out = ranked.select("id", *kept, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select("id", *kept, F.lit(None).cast("long").alias("rank"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)
