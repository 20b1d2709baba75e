"""N-gram Jaccard join: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import mix, runs, slices, whole_runs, word_hashes, words
from lakemill.llm.graph import components
from lakemill.llm.keys import bit_map, marked, named, row_key
from lakemill.llm.storage import cut, drop, shuffled, tasks

#: What one comparison holds of each of two blocks: documents and shingles, about.
BLOCK_DOCS, BLOCK_SHINGLES = 2000, 1_500_000
#: Sizes of sets for which prefixes are worked out one by one.
SIZES = 64
#: Row keys that a task remembers, to send a repeated row once.
REMEMBERED = 200_000
#: Pairs that are looked at together, and 64-bit words of their bit sets.
PAIRS, WORDS = 4096, 512
#: Probability with which the signatures of two sets at the threshold agree so seldom that the pair isn't verified.
MISS_BY_SKETCH = 1e-12


def forest_depth(trees: int, deepest: int, threshold: float, target: float) -> int:
    """How far prefixes have to be shortened.

    A pair at the threshold agrees on a prefix of ``d`` values in a tree with
    probability ``threshold ** d``. From ``deepest`` on, prefixes are shortened
    until such a pair meets in one of ``trees`` tries with probability
    ``target``; more similar pairs meet sooner.
    """
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity, at the threshold or above, that a set of ``n`` shingles can have with another set; above 1 if it can have none."""
    found = 2.0
    for shared in range(math.ceil(threshold * n - 1e-9), n + 1):
        union = math.floor(shared / threshold + 1e-9)
        if union >= n and union > shared:
            found = min(found, shared / union)
    return found


@functools.cache
def depths(trees: int, deepest: int, threshold: float, target: float) -> np.ndarray:
    """For sets of each size, how far their prefixes are shortened; larger sets are like the last one, 0: no other set is similar.

    What similarities a small set can have leaves gaps above the threshold, so
    that longer prefixes meet the target for it.
    """
    # beyond this size a similarity lies so close above the threshold that gaps decide nothing
    sizes = [least_similarity(n, threshold) for n in range(SIZES)]
    return np.array([0 if not n or s > 1 else forest_depth(trees, deepest, s, target) for n, s in enumerate(sizes)] + [forest_depth(trees, deepest, threshold, target)])


def least_agreement(values: int, threshold: float, miss: float) -> int:
    """How many of ``values`` MinHash values two sets at the threshold agree on, but for a probability of ``miss``."""
    below, k = 0.0, 0
    while k < values:
        below += math.exp(math.lgamma(values + 1) - math.lgamma(k + 1) - math.lgamma(values - k + 1) + k * math.log(threshold) + (values - k) * math.log1p(-threshold)) if threshold < 1 else 0.0
        if below > miss:
            break
        k += 1
    return k


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and how many each text has.

    A text of fewer than ``width`` words has one shingle of all of them; one
    without words has none.
    """
    ids, vocabulary, counts = words(text)
    hashes = word_hashes(vocabulary)[ids]
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.uint64(0x9E3779B97F4A7C15)
    found, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        h = hashes[:n].copy()
        for k in range(1, width):
            h *= base
            h += hashes[k : n + k]
        whole = doc[:n] == doc[width - 1 :]
        found, of = mix(h[whole]), doc[:n][whole]
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for i in short.tolist():
            h = np.array([counts[i]], dtype=np.uint64)
            for x in hashes[ends[i] - counts[i] : ends[i]]:
                h = h * base + x
            extra.append(h)
        found, of = np.concatenate([found, mix(np.concatenate(extra))]), np.concatenate([of, short])
    if len(short):
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
    start = 0
    for end in np.cumsum(np.bincount(of, minlength=len(counts))).tolist():
        found[start:end].sort()
        start = end
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.bincount(of[new], minlength=len(counts))


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits that equal sets share; none for an empty set."""
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    out: list[bytes | None] = [None] * len(counts)
    if len(full):
        one = np.add.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), starts)
        two = np.add.reduceat(mix(hashes + np.uint64(0xE7037ED1A0B428DB)), starts)
        pairs = np.stack([mix(one), mix(two)], axis=1).astype(">u8")
        for i, pair in zip(full.tolist(), pairs, strict=True):
            out[i] = pair.tobytes()
    return out


def signatures(hashes: np.ndarray, counts: np.ndarray, trees: int, deepest: int, seed: int = 1) -> np.ndarray:
    """The path of each text with shingles down each tree, as int64: a byte for each of ``deepest`` MinHash values, the first one highest.

    Paths in order are a trie: what two of them share is the bytes before the first that differs.
    """
    starts = (np.cumsum(counts) - counts)[counts > 0]
    random = np.random.default_rng(seed)
    factors, spread = (random.integers(1 << 31, size=trees * deepest, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    terms = random.integers(1 << 32, size=trees * deepest, dtype=np.uint32)
    half = (hashes >> np.uint64(32)).astype(np.uint32)
    paths = np.zeros((len(starts), trees), dtype=np.uint64)
    work = np.empty_like(half)
    for at in range(trees * deepest if len(starts) else 0):
        np.multiply(half, factors[at], out=work)
        work += terms[at]
        # the least of a large set is a small number: its high bits say something only when they are spread
        value = np.minimum.reduceat(work, starts) * spread[at]
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(24)
        paths[:, at // deepest] |= value.astype(np.uint64) << np.uint64(56 - 8 * (at % deepest))
    return paths.view(np.int64)


def leads(size: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest index that each index is connected with by pairs, itself included."""
    lead = np.arange(size)
    while True:
        new = lead.copy()
        np.minimum.at(new, one, lead[two])
        np.minimum.at(new, two, lead[one])
        new = new[new]
        if (new == lead).all():
            return lead
        lead = new


def pairs_of(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within runs of ``counts`` rows, some runs or part of one at a time."""
    size = np.repeat(counts, counts)
    place = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
    later = size - place - 1
    ends, start = np.cumsum(later), 0
    while start < len(later):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + 64 * PAIRS, side="right")))
        n = later[start:stop]
        one = np.repeat(np.arange(start, stop), n)
        yield one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
        start = stop


def met(rows: pa.RecordBatch, threshold: float, depth_of: np.ndarray, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are to be verified, each in the first tree in which it meets.

    Rows come in the order of their paths. For each depth, the longest first, the paths are walked: those with a
    common prefix of that many values follow each other, and two classes meet
    there if the longer of their two depths is this one. Pairs whose sizes or signatures rule the
    threshold out are left out.
    """
    paths = rows.column("paths").flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
    n, block = rows.column("n").to_numpy(), rows.column("block").to_numpy()
    tree = (rows.column("bucket").to_numpy() & 255).astype(np.int64)
    depth = depth_of[np.minimum(n, len(depth_of) - 1)]
    between = rows.column("one").to_numpy() != rows.column("two").to_numpy()
    keys = [rows.column(c).to_numpy() for c in ("bucket", "one", "two")]
    walked = paths[np.arange(len(rows)), tree]
    for level in sorted(set(depth.tolist()), reverse=True):
        shift = np.uint64(64 - 8 * level)
        able = np.flatnonzero(depth <= level)
        parts = np.ones(len(able), dtype=bool)
        parts[1:] = np.any([k[able][1:] != k[able][:-1] for k in (*keys, walked >> shift)], axis=0)
        for i, j in pairs_of(np.diff([*np.flatnonzero(parts), len(able)])):
            one, two = able[i], able[j]
            fits = np.minimum(n[one], n[two]) >= threshold * np.maximum(n[one], n[two]) - 1e-9
            fits &= (np.maximum(depth[one], depth[two]) == level) & (~between[one] | (block[one] != block[two]))
            # most pairs of a large group meet in the first trees
            for t in range(min(2, paths.shape[1])):
                fits &= (tree[one] <= t) | ((paths[one, t] ^ paths[two, t]) >> shift != 0)
            one, two = one[fits], two[fits]
            for a in range(0, len(one), PAIRS):
                i, j = one[a : a + PAIRS], two[a : a + PAIRS]
                apart = paths[i] ^ paths[j]
                same = (apart.view(np.uint8) == 0).sum(axis=1) >= agree
                # that they meet here is known; not so whether it's the first time
                here = same & ((apart >> shift == 0).argmax(axis=1) == tree[i])
                if here.any():
                    yield i[here], j[here]


def bit_sets(hashes: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Sets as rows of bits, a bit for each shingle that two sets have, some columns of 64-bit words at a time."""
    of = np.repeat(np.arange(len(counts)), counts)
    _, column, uses = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = uses > 1
    column, of = (np.cumsum(shared) - 1)[column[shared[column]]], of[shared[column]]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    width = 64 * WORDS
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        word, bit = (column[a:b] - start) >> 6, np.uint64(1) << ((column[a:b] - start) & 63).astype(np.uint64)
        bits = np.zeros((len(counts), int(word[-1]) + 1), dtype=np.uint64)
        np.bitwise_or.at(bits, (of[a:b], word), bit)
        yield bits


def linked_pairs(hashes: np.ndarray, counts: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more, by exact counts of what they share."""
    both = np.zeros(len(one), dtype=np.int64)
    for bits in bit_sets(hashes, counts):
        for a in range(0, len(one), PAIRS):
            both[a : a + PAIRS] += np.bitwise_count(bits[one[a : a + PAIRS]] & bits[two[a : a + PAIRS]]).sum(axis=1, dtype=np.int64)
    return both / np.maximum(1, counts[one] + counts[two] - both) >= threshold


def profile(docs: DataFrame, width: int, trees: int, deepest: int, depth_of: np.ndarray) -> DataFrame:
    """For each row: id, row key, a key of its shingle set, half of that as a number, the set's size and its paths (empty if no other set is similar)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = shingle_sets(part.column("text"), width)
                paths = signatures(hashes, counts, trees, deepest)
                some = depth_of[np.minimum(counts, len(depth_of) - 1)] > 0
                ends = pa.array(np.concatenate([[0], np.cumsum(some * trees)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(paths[some[counts > 0]].ravel()))
                keys = set_keys(hashes, counts)
                node = [int.from_bytes(k[:8], "big", signed=True) if k else None for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("rkey"), pa.array(keys, pa.binary()), pa.array(node, pa.int64()), pa.array(counts, pa.int64()), lists], ["id", "rkey", "ckey", "node", "n", "paths"]
                )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, rkey binary, ckey binary, node long, n long, paths array<long>")


def jaccard_join(docs: DataFrame, width: int = 5, threshold: float = 0.8, trees: int = 32, deepest: int = 8, target: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents linked by a Jaccard similarity of ``threshold`` or more between their word shingles.

    Rows with equal shingle sets are a class. A class has a path of ``deepest``
    MinHash values down each of ``trees`` prefix tries. Prefixes that have to
    match are shortened, from ``deepest`` values on, for each class until its tries find the
    least similar set that a class of its size can be linked with (at the
    threshold or above) with probability ``target`` (:func:`depths`). Tries are
    dealt out by the shortest prefix of all; the paths under one are sorted, and
    classes that share enough values there have met. A pair that has met is
    judged in the first trie where it does: sizes and signatures that rule the
    threshold out drop it (:data:`MISS_BY_SKETCH`), and for the others, and only
    for them, shingles are fetched and compared exactly.

    Classes under one prefix are cut into blocks, and each pair of blocks is
    compared apart. Pairs never become rows: a comparison returns a count of
    links and a leader for each class, and linked classes are joined to groups by
    connected components.

    Returns, for each row: ``id_col``; ``class_id``, the smallest id with the same
    set; ``n_links`` long, other rows linked with it, those of its class
    included; ``component_id``, the smallest id that links lead to; ``kept``,
    true for the one row of its group that stays (the smallest id; of equal ids
    the smallest row key, and all rows equal to that row in id and text); and
    ``rkey``, the 128-bit key of id and text.

    Texts of fewer than ``width`` words have one shingle of all words. Null
    texts and those without words link with nothing: class and component are
    their own id, and they are kept. Null ids are rows like others; other
    columns are ignored, whatever their names; an empty table gives no rows. A class, or a text, of
    any number of rows is counted map-side first.
    """
    depth_of = depths(trees, deepest, threshold, target)
    shortest = min(7, int(depth_of[depth_of > 0].min()))
    if trees > 256 or deepest > 8:
        raise ValueError("a path has at most 8 values, and there are 256 trees at most")
    agree = least_agreement(trees * deepest, threshold, MISS_BY_SKETCH)
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    rows = rows.withColumn("rkey", row_key(F.col("id"), F.col("text")))
    profiles = cut(profile(rows, width, trees, deepest, depth_of), "profiles")
    classes = profiles.where("ckey is not null").groupBy("ckey").agg(
        F.count("*").alias("size"), F.min("id").alias("class_id"), F.min(F.struct("id", "rkey")).rkey.alias("rkey"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("paths").alias("paths")
    )
    classes = cut(classes, "classes")
    # paths are the classes' from here on
    rows_of = cut(profiles.select("id", "rkey", "ckey"), "rows")
    drop(profiles)
    members = cut(_members(classes, shortest), "members")
    # a node is half of a class's key: of two classes that share it, both are looked at
    placed = members.join(shuffled(classes.select("node", "ckey", "n", "paths")), "node").drop("node")
    meetings = cut(_dealt(placed, tasks(members)).mapInArrow(_meetings(threshold, depth_of, agree), "ckey binary, bucket long, one long, two long, block long"), "meetings")
    drop(members)
    sets = _sets(rows, classes, meetings, width)
    compared = cut(_dealt(meetings.join(shuffled(sets), "ckey"), tasks(meetings)).mapInArrow(_links(threshold, depth_of, agree), "ckey binary, links long, lead binary"), "compared")
    for done in (meetings, sets):
        drop(done)
    links = compared.groupBy("ckey").agg(F.sum("links").alias("links"))
    tops = components(compared.where("ckey <> lead"), "ckey", "lead", "ckey", "top")
    groups = classes.select("ckey", "size", "class_id", "rkey").join(shuffled(links), "ckey", "left").join(shuffled(tops), "ckey", "left")
    groups = groups.withColumn("top", F.coalesce("top", "ckey"))
    heads = groups.groupBy("top").agg(F.min("class_id").alias("component_id"), F.min(F.struct(F.col("class_id"), F.col("rkey"))).rkey.alias("head"))
    groups = groups.join(shuffled(heads), "top").select("ckey", "size", "class_id", "links", "component_id", "head")
    found = rows_of.join(shuffled(groups), "ckey", "left")
    own = lambda c: F.when(F.col("ckey").isNull(), F.col("id")).otherwise(F.col(c)).alias(c)
    n_links = F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return found.select(F.col("id").alias(id_col), own("class_id"), n_links.alias("n_links"), own("component_id"), (F.col("ckey").isNull() | (F.col("rkey") == F.col("head"))).alias("kept"), "rkey")


def _members(classes: DataFrame, shortest: int) -> DataFrame:
    """Classes under each prefix that others share, (bucket, one, two, block, node): a row for each pair of blocks that a class is compared in.

    A bucket is a prefix of ``shortest`` values with the number of its tree in the last byte.
    """
    top = F.lit(-1 << (64 - 8 * shortest))
    leaves = classes.select("node", "n", F.posexplode("paths").alias("t", "path")).select("node", "n", F.col("path").bitwiseAND(top).bitwiseOR(F.col("t").cast("long")).alias("bucket"))
    shared = leaves.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("w")).where("k > 1")
    shared = shared.select("bucket", F.greatest(F.ceil(F.col("k") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_SHINGLES)).alias("blocks"))
    found = leaves.select("node", "bucket").join(shuffled(shared), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").cast("long").alias("one"), F.greatest(x, "block").cast("long").alias("two")))).alias("pair")
    return found.select("bucket", pair, "block", "node").select("bucket", "pair.one", "pair.two", "block", "node")


def _dealt(placed: DataFrame, to: int) -> DataFrame:
    """Members of each pair of blocks in a row, as paths in order."""
    return placed.repartition(to, "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", F.get("paths", F.col("bucket").bitwiseAND(F.lit(255)).cast("int")))


def _meetings(threshold: float, depth_of: np.ndarray, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["bucket", "one", "two"]):
            used = np.zeros(len(rows), dtype=bool)
            for i, j in met(rows, threshold, depth_of, agree):
                used[i] = used[j] = True
            yield rows.select(["ckey", "bucket", "one", "two", "block"]).filter(pa.array(used))

    return run


def _sets(rows: DataFrame, classes: DataFrame, meetings: DataFrame, width: int) -> DataFrame:
    """The shingles of each class that has met another, a written table: (ckey, size, n, paths, shingles)."""
    wanted = cut(meetings.select("ckey").distinct().join(shuffled(classes.select("ckey", "rkey", "size", "n", "paths")), "ckey"), "wanted")
    found = bit_map(wanted.select(F.xxhash64("rkey").alias("h")), wanted.count())
    # texts of other classes stay where they are
    texts = rows.where(marked(found, F.xxhash64("rkey"))).select("rkey", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a repeated row a task sends one, as long as it remembers it
        seen: set[bytes] = set()
        for batch in batches:
            fresh = [i for i, k in enumerate(batch.column("rkey").to_pylist()) if not (k in seen or seen.add(k))]
            for part in slices(batch.take(pa.array(fresh, pa.int64())), "text"):
                hashes, counts = shingle_sets(part.column("text"), width)
                raw, ends = hashes.tobytes(), 8 * np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([part.column("rkey"), pa.array([raw[e - 8 * n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary())], ["rkey", "shingles"])
            if len(seen) > REMEMBERED:
                seen.clear()

    sent = texts.mapInArrow(run, "rkey binary, shingles binary")
    sets = cut(sent.join(shuffled(wanted), "rkey").drop("rkey").dropDuplicates(["ckey"]), "sets")
    drop(wanted)
    return sets


def _links(threshold: float, depth_of: np.ndarray, agree: int):
    """Classes compared under each prefix where pairs meet first: (ckey, links, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["bucket", "one", "two"]):
            found = [*met(rows, threshold, depth_of, agree)]
            if not found:
                continue
            counts, raw = rows.column("n").to_numpy(), rows.column("shingles")
            hashes = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint64)
            one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            linked = linked_pairs(hashes, counts, one, two, threshold)
            one, two, size = one[linked], two[linked], rows.column("size").to_numpy()
            links = np.bincount(one, size[two], len(rows)).astype(np.int64) + np.bincount(two, size[one], len(rows)).astype(np.int64)
            some = pa.array(links > 0)
            lead = rows.column("ckey").take(pa.array(leads(len(rows), one, two)))
            yield pa.RecordBatch.from_arrays([rows.column("ckey").filter(some), pa.array(links).filter(some), lead.filter(some)], ["ckey", "links", "lead"])

    return run
