"""Nearest vectors by cosine: exact search, in blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakemill.sources.scratch import cut

#: Bytes of the queries that go to the executors at once. Rows are read once for each such part.
PART_BYTES = 64 << 20
#: Queries and rows whose products are in memory at once.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 4096
#: Decimals of a cosine: equal vectors get equal ones, in whichever blocks they meet.
DECIMALS = 9


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and where in ``vectors`` they are; those that have no direction are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    with np.errstate(over="ignore", invalid="ignore"):
        # the largest component first, so that squares stay in range
        peak = np.abs(flat).max(axis=1, initial=0.0)
        good = np.isfinite(peak) & (peak > 0)
        at, flat = at[good], flat[good] / peak[good, None]
    return flat / np.sqrt((flat * flat).sum(axis=1))[:, None], at


class Heaps:
    """The ``k`` best rows of each query so far: highest cosine first, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.best = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in batched(range(len(ids)), BLOCK_QUERIES)]

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        for b, (query, cosine, other) in enumerate(self.best):
            start = b * BLOCK_QUERIES
            block = self.queries[start : start + BLOCK_QUERIES]
            products = np.round(block @ rows.T, DECIMALS)
            products[self.ids[start : start + len(block), None] == ids[None, :]] = -np.inf
            # what can't be among the first k isn't looked at again
            least = np.partition(products, -self.k, axis=1)[:, -self.k] if products.shape[1] > self.k else np.full(len(block), -np.inf)
            full = np.bincount(query, minlength=len(block)) >= self.k
            lowest = np.full(len(block), np.inf)
            np.minimum.at(lowest, query, cosine)
            least = np.where(full, np.maximum(least, lowest), least)
            q, r = np.nonzero((products >= least[:, None]) & (products > -np.inf))
            query, cosine, other = np.concatenate([query, q]), np.concatenate([cosine, products[q, r]]), np.concatenate([other, ids[r]])
            order = np.lexsort((other, -cosine, query))
            query, cosine, other = query[order], cosine[order], other[order]
            first = np.searchsorted(query, np.arange(len(block)))
            kept = np.arange(len(query)) - first[query] < self.k
            self.best[b] = query[kept], cosine[kept], other[kept]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for b, (query, cosine, other) in enumerate(self.best):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[query + b * BLOCK_QUERIES]), pa.array(other), pa.array(cosine + 0.0)], ["query_id", "other_id", "cosine"])


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The ``k`` vectors of ``rows`` most alike each one of ``queries``, by cosine: (query_id, rank, other_id, cosine).

    Exact: every query meets every row but those with its own id, in products of blocks. Queries go to the
    executors in parts of :data:`PART_BYTES`, so that their number has no
    bound; rows don't move at all. Each task keeps a heap of ``k`` for each query of the
    part and sends those; Spark merges them by query, dropping what isn't among the first
    ``k`` before and after it shuffles. Cosines are rounded to nine decimals, and of equal ones
    the smaller id counts.

    Ids are whole numbers. Vectors without a direction (null, of zeros, with a null or a number that
    isn't finite), of another length than most queries' or with a null id are neither queries nor found. Ids of
    queries that come twice count once, with the first of their vectors in order.
    """
    spark = rows.sparkSession
    pairs = lambda df: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = cut(pairs(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    sizes = asked.where("v is not null").groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, other_id long, cosine double"
    if sizes is None or not sizes["size"]:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    parts = max(1, -(-sizes.n * size * 8 // PART_BYTES))
    out = None
    for part in range(parts):
        mine = asked.where((F.size("v") == size) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).toArrow()
        vectors, at = _matrix(mine.column("v"), size)
        sent = spark.sparkContext.broadcast((vectors, mine.column("id").to_numpy()[at]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            heaps = Heaps(*sent.value, k)
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    piece = batch.slice(start, BLOCK_ROWS)
                    vectors, at = _matrix(piece.column("v"), size)
                    if len(at):
                        heaps.add(vectors, piece.column("id").to_numpy()[at])
            yield from heaps.rows()

        found = pairs(rows).mapInArrow(run, "query_id long, other_id long, cosine double")
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "other_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "other_id", "cosine")
