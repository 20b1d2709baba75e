"""Embedding near-dedup: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import mix, whole_runs
from lakemill.llm.graph import components
from lakemill.llm.keys import named
from lakemill.llm.ngram_join import PAIRS, leads, least_agreement, pairs_of
from lakemill.llm.storage import cut, drop, shuffled, tasks

#: Vectors of each of two blocks that one comparison holds, about.
BLOCK = 1000
#: Probability with which the sketches of two vectors at the threshold agree so seldom that the pair isn't verified.
MISS_BY_SKETCH = 1e-9


def tables_for(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of tables.

    Bits grow with the logarithm of the number of rows, so that unlike vectors
    seldom share a key. Two vectors at the threshold agree on a bit with
    probability 1 - angle / pi; there are as many tables as it takes for such a
    pair to agree in none with probability ``miss`` at most.
    """
    bits = min(30, max(8, math.ceil(math.log2(max(2, rows)))))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if agree >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def unit_vectors(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, vector, length) of the usable vectors of one batch, padded with zeros to one length.

    Null and zero vectors and those with null or non-finite components are left out.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    dense = np.zeros((len(sizes), int(sizes.max(initial=0))))
    dense[row, column] = flat
    largest = np.abs(dense).max(axis=1, initial=0)
    good = np.flatnonzero(np.isfinite(largest) & (largest > 0))
    # scaled first, so that squares neither overflow nor vanish
    dense = dense[good] / largest[good, None]
    return good, dense / np.linalg.norm(dense, axis=1)[:, None], sizes[good]


def sign_keys(vectors: np.ndarray, sizes: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Keys of unit vectors in each table, int32: the sides of ``bits`` random hyperplanes that they are on."""
    out = np.zeros((len(vectors), tables), dtype=np.int32)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        planes = np.random.default_rng([seed, size]).standard_normal((size, tables * bits))
        sides = (vectors[at, :size] @ planes > 0).reshape(len(at), tables, bits)
        out[at] = sides @ (1 << np.arange(bits))
    return out


def class_keys(lists: pa.ListArray, labels: np.ndarray) -> np.ndarray:
    """128 bits for each list of numbers, as rows of 16 bytes, that lists share if their values and labels are equal; nulls are empty lists."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    # a zero has one sign
    bits = (pc.fill_null(pc.list_flatten(lists).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) + 0.0).view(np.uint64)
    start = np.cumsum(sizes) - sizes
    place = (np.arange(len(bits)) - np.repeat(start, sizes)).astype(np.uint64)
    halves = []
    for seed in (1, 2):
        total, full = np.zeros(len(sizes), dtype=np.uint64), np.flatnonzero(sizes)
        if len(full):
            total[full] = np.add.reduceat(mix(bits ^ mix(place * np.uint64(2) + np.uint64(seed))), start[full])
        halves.append(mix(total + mix(labels.view(np.uint64) ^ sizes.astype(np.uint64) << np.uint64(40)) * np.uint64(seed * 2 + 1)))
    return np.stack(halves, axis=1).view(np.uint8)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-7, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label"
) -> DataFrame:
    """Vectors linked by a cosine of ``threshold`` or more, and the groups that links make.

    Only vectors of one length, and of one label where ``label_col`` is given,
    are compared; a null label is compared with none. Equal vectors are one class,
    for which one of them is compared. Vectors that share a key
    in one of the tables (:func:`tables_for`) have met; 64 more signs, which go
    with the key, tell strangers apart (:data:`MISS_BY_SKETCH`), and only for the others are vectors
    fetched: each pair left is verified by its cosine in double precision, in the first table in
    which it meets. Keys held by many vectors are cut into blocks, and each pair
    of blocks is compared apart. Pairs never become rows: a comparison returns a
    count of links and a leader for each vector, and leaders are joined to groups
    by distributed connected components.

    Returns, for each row: ``id_col``, ``n_links`` long, ``component_id`` (the
    smallest id that links lead to), ``kept`` (the id is the component's). Null
    and zero vectors and those with null or non-finite components have no links.
    Rows with equal ids are vectors of their own; a null id without links has a
    null component and is kept. Other columns are ignored, whatever their names; an empty table gives
    no rows.
    """
    bits, tables = tables_for(vectors.count(), threshold, miss)
    agree = least_agreement(64, 1 - math.acos(min(1.0, threshold)) / math.pi, MISS_BY_SKETCH)
    label = named(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), named(id_col).alias("id"), F.xxhash64(label).alias("lab"), label.isNotNull().alias("labelled"), named(vector_col).alias("v"))
    id_type, kind = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        kind, rows = "array<double>", rows.withColumn("v", F.col("v").cast("array<double>"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                lists = pc.if_else(pc.fill_null(part.column("labelled"), False), part.column("v"), None)
                good, units, sizes = unit_vectors(lists)
                at = np.full(part.num_rows, -1)
                at[good] = np.arange(len(good))
                take = pa.array(at, mask=at < 0)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * tables, pa.int32()), pa.array(sign_keys(units, sizes, bits, tables, seed).ravel())).take(take)
                signs = sign_keys(units, sizes, 16, 4, seed + 1).astype(np.uint64)
                sketch = pa.array((signs << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64).view(np.int64)).take(take)
                classes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), part.num_rows, [None, pa.py_buffer(class_keys(lists, part.column("lab").to_numpy()).tobytes())]).cast(pa.binary())
                classes = pc.if_else(pa.array(at >= 0), classes, None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "id", "lab", "v")), keys, sketch, classes], ["rid", "id", "lab", "v", "keys", "sketch", "class"])

    known = cut(rows.mapInArrow(keyed, f"rid long, id {id_type}, lab long, v {kind}, keys array<int>, sketch long, class binary"), "vectors")
    usable = known.where("class is not null")
    classes = cut(usable.groupBy("class").agg(F.count("*").alias("size"), F.min("rid").alias("rid")), "classes")
    usable = cut(usable.select("rid", "lab", "v", "keys", "sketch").join(shuffled(classes.select("rid", "size")), "rid"), "distinct")
    # vectors are needed once for each class from here on
    slim = cut(known.select("rid", "id", "class"), "rows")
    drop(known)
    leaves = usable.select("rid", "lab", "sketch", F.size("v").alias("dim"), F.posexplode("keys").alias("t", "key")).select("rid", "sketch", "t", F.xxhash64("lab", "dim", "t", "key").alias("bucket"))
    shared = leaves.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    members = leaves.join(shuffled(shared), "bucket").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").cast("long").alias("one"), F.greatest(x, "block").cast("long").alias("two")))).alias("pair")
    members = cut(members.select("bucket", "t", pair, "block", "rid", "sketch").select("bucket", "t", "pair.one", "pair.two", "block", "rid", "sketch"), "members")
    meetings = cut(_dealt(members, members).mapInArrow(_meetings(agree), "bucket long, t int, one long, two long, block long, rid long, sketch long"), "meetings")
    drop(members)
    compared = cut(_dealt(meetings.join(shuffled(usable.select("rid", "size", "v", "keys")), "rid"), meetings).mapInArrow(_links(agree, threshold), "rid long, links long, lead long"), "compared")
    for done in (meetings, usable):
        drop(done)
    links = compared.groupBy("rid").agg(F.sum("links").alias("links"))
    tops = components(compared.where("lead <> rid"), "rid", "lead", "rid", "top")
    groups = classes.join(shuffled(links), "rid", "left").join(shuffled(tops), "rid", "left").select("class", "size", "links", F.coalesce("top", "rid").alias("top"))
    found = slim.join(shuffled(groups), "class", "left").withColumn("top", F.coalesce("top", "rid"))
    heads = found.groupBy("top").agg(F.min("id").alias("component_id"))
    n_links = F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    out = found.join(shuffled(heads), "top").select(F.col("id").alias(id_col), n_links.alias("n_links"), "component_id")
    return out.withColumn("kept", named(id_col).eqNullSafe(F.col("component_id")))


def _dealt(placed: DataFrame, counted: DataFrame) -> DataFrame:
    return placed.repartition(tasks(counted), "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")


def _alike(rows: pa.RecordBatch, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors with one key whose sketches agree on enough signs."""
    sketch, block = rows.column("sketch").to_numpy().view(np.uint64), rows.column("block").to_numpy()
    keys = [rows.column(c).to_numpy() for c in ("bucket", "one", "two")]
    between = keys[1] != keys[2]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    for one, two in pairs_of(np.diff([*np.flatnonzero(new), len(rows)])):
        fits = np.bitwise_count(sketch[one] ^ sketch[two]) <= 64 - agree
        fits &= ~between[one] | (block[one] != block[two])
        if fits.any():
            yield one[fits], two[fits]


def _meetings(agree: int):
    """Vectors whose sketch agrees with that of another under one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["bucket", "one", "two"]):
            used = np.zeros(len(rows), dtype=bool)
            for one, two in _alike(rows, agree):
                used[one] = used[two] = True
            yield rows.filter(pa.array(used)).select(["bucket", "t", "one", "two", "block", "rid", "sketch"])

    return run


def _links(agree: int, threshold: float):
    """Vectors compared under each key where pairs meet first: (rid, links, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["bucket", "one", "two"]):
            _, v, _ = unit_vectors(rows.column("v"))
            keys, t = rows.column("keys").flatten().to_numpy().reshape(len(rows), -1), rows.column("t").to_numpy()
            found = [(np.zeros(0, dtype=np.int64),) * 2]
            for one, two in _alike(rows, agree):
                for a in range(0, len(one), PAIRS):
                    i, j = one[a : a + PAIRS], two[a : a + PAIRS]
                    # a pair counts in the first table in which it meets
                    first = (keys[i] == keys[j]).argmax(axis=1) == t[i]
                    i, j = i[first], j[first]
                    near = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
                    found.append((i[near], j[near]))
            one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            size, ids = rows.column("size").to_numpy(), rows.column("rid").to_numpy()
            links = (np.bincount(one, size[two], len(rows)) + np.bincount(two, size[one], len(rows))).astype(np.int64)
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (ids, links, ids[leads(len(rows), one, two)])], ["rid", "links", "lead"])

    return run
