"""Arrow helpers that the Python operators share: bounded slices, words, sorted runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Everything between two words.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Everything between two runs of letters.
NOT_LETTERS = r"[^\p{L}]+"
#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1_500_000


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``budget`` bytes of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    # what Arrow keeps for later would add up over the stages that a worker serves
    pa.default_memory_pool().release_unused()


def split(text: pa.Array, pattern: str, lower: bool = True, by: str = " ") -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Pieces of each text between matches of ``pattern`` as (ids, vocabulary, pieces per text).

    Nulls count as empty texts; empty pieces don't exist. ``by`` has to match
    ``pattern``.
    """
    text = pc.fill_null(text, "")
    text = pc.utf8_lower(text) if lower else text
    text = pc.utf8_trim(pc.replace_substring_regex(text, pattern=pattern, replacement=by), characters=by)
    lists = pc.split_pattern(text, pattern=by)
    flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
    counts = np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, counts)
    if len(flat) != counts.sum():
        flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, counts


def words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased runs of letters and digits."""
    return split(text, NOT_WORD)


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and how many each text has; no nulls."""
    text = text.cast(pa.large_string())
    if not len(text):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    _, ends, raw = text.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], np.diff(ends)


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hashes of words: sums of random numbers for their bytes, each times a power for its place, mixed with the length."""
    raw, sizes = flat(vocabulary)
    if not len(raw):
        return np.zeros(len(sizes), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    random = np.random.default_rng(0x5EED).integers(1 << 64, size=256, dtype=np.uint64)
    powers = np.full(int(sizes.max()), 0xD6E8FEB86659FD93, dtype=np.uint64)
    powers[0] = 1
    terms = random[raw] * np.multiply.accumulate(powers)[place]
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), dtype=np.uint64)
    out[full] = np.add.reduceat(terms, starts[full])
    return mix(out + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches sorted by ``keys`` (integers without nulls)."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for key in keys:
            x = batch.column(key).to_numpy(zero_copy_only=False)
            new |= x[1:] != x[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            yield batch.slice(start, stop - start)
        rest = batch.slice(bounds[-1])
    if rest is not None:
        yield rest


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``keys`` (integers without nulls), cut so that all rows of a key are in one of them."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, dtype=bool)
        for key in keys:
            x = batch.column(key).to_numpy(zero_copy_only=False)
            same &= x == x[last]
        start = int(same.argmax())
        if start:
            yield batch.slice(0, start)
        rest = batch.slice(start)
    if rest is not None:
        yield rest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
