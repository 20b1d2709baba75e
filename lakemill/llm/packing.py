"""Packing of token sequences: first-fit decreasing over a tournament tree."""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import slices
from lakemill.llm.keys import named
from lakemill.llm.ranking import repeats
from lakemill.llm.storage import cut

#: Encodings of chunks that a task keeps, in about 250 bytes each; once full, rarer ones are encoded again.
CACHED_CHUNKS = 250_000
#: Bytes of text that are encoded at once: the more, the fewer chunks are looked up twice.
SLICE_BYTES = 2_000_000
#: White space that may be cut at: no pre-token spans it. (What stands between two of them is an empty chunk, without ids.)
BLANKS = (" ", "\n", "\t")
#: ASCII punctuation, apostrophes aside, between a letter and white space: a pre-token of its own. (Other capitals: one gets a mark when lowered.)
AFTER_WORD = r"([\p{Ll}\p{Lm}\p{Lo}A-Z])([!-&(-/:-@\[-`{-~]+)([ \n\t]|$)"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes texts chunk by chunk, each distinct chunk once.

    The tokenizer drops white space before it looks at words, so the ids of a
    text are those of its chunks between blanks, in order; punctuation that ends
    a word is parted from it too. A chunk of composed letters alone is a single
    pre-token and goes straight to the merges; all others go through the whole
    tokenizer. So do whole texts that hold one of the tokenizer's added tokens, which it
    looks for before anything else.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.added = [(t.content, t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        """Let all encodings go."""
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 18, dtype=np.int64)
        self.sizes = np.zeros(1 << 18, dtype=np.int64)
        self.used = 0

    def _whole(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk."""
        lowered = [c.lower() if c.isalpha() and unicodedata.is_normalized("NFC", c) and "Σ" not in c else "" for c in chunks]
        merge, letters = self.merges.tokenize, self.letters
        out = [[t.id for t in merge(w.encode().decode("latin-1").translate(letters))] if w.isalpha() else None for w in lowered]
        others = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([chunks[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _room(self, name: str, size: int) -> np.ndarray:
        old = getattr(self, name)
        if len(old) < size:
            new = np.zeros(max(size, 2 * len(old)), dtype=old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)
        return getattr(self, name)

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; the numbers of those that aren't kept hold until the next call."""
        slots = np.fromiter((self.known.get(c, -1) for c in chunks), dtype=np.int64, count=len(chunks))
        fresh = [chunks[i] for i in np.flatnonzero(slots < 0)]
        if fresh:
            first, end = len(self.known), len(self.known) + len(fresh)
            encoded = self._whole(fresh)
            sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(fresh))
            total = int(sizes.sum())
            self._room("ids", self.used + total)[self.used : self.used + total] = np.concatenate([np.asarray(e, dtype=np.uint32) for e in encoded])
            self._room("sizes", end)[first:end] = sizes
            self._room("starts", end)[first:end] = self.used + np.cumsum(sizes) - sizes
            slots[slots < 0] = np.arange(first, end)
            if end <= CACHED_CHUNKS:
                self.used += total
                self.known.update(zip(fresh, range(first, end), strict=True))
        return slots

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; nulls count as empty."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), dtype=bool)
        for token, any_case in self.added:
            whole |= pc.match_substring(texts, token, ignore_case=any_case).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_chunks(texts)
        ids, counts = self._by_chunks(pc.if_else(pa.array(whole), "", texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts])

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        spaced = pc.replace_substring_regex(texts, pattern=AFTER_WORD, replacement=r"\1 \2\3")
        for blank in BLANKS[1:]:
            spaced = pc.replace_substring(spaced, pattern=blank, replacement=BLANKS[0])
        lists = pc.split_pattern(spaced, pattern=BLANKS[0])
        coded = lists.flatten().dictionary_encode()
        slot = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes, starts = self.sizes[slot], self.starts[slot]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]]
        return ids, np.diff(bounds)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """One tokenizer for each Python worker, on one thread: tasks take the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


class FirstFit:
    """Open bins under a tournament tree: each node has the most room below it.

    ``place`` finds the first bin with room for a size in logarithmic time.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the room that it had; there has to be a bin with room."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size, its bin and its offset there; sizes are from 1 to ``capacity``."""
    tree = FirstFit(max(1, len(sizes)), capacity)
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids, cut every ``capacity``: (id, start, length, ids_crc32, doc_tokens, key, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, counts = own.encode(part.column("text"))
                rows, at = [], 0
                for i, n in enumerate(counts.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    rows += [(i, s, len(piece := whole[s : s + capacity]), zlib.crc32(piece.tobytes()), n + 1) for s in range(0, n + 1, capacity)]
                index, *rest = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
                kept = [part.column(c).take(pa.array(index)) for c in ("id", "key", "row")]
                yield pa.RecordBatch.from_arrays([kept[0], *map(pa.array, rest), *kept[1:]], ["id", "start", "length", "ids_crc32", "doc_tokens", "key", "row"])
        own.forget()

    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    rows = rows.select("id", "text", F.xxhash64(F.lit("packing"), "id", "text").alias("key"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, key long, row long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 8192) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    A document is its ids and ``end_id``, cut every ``capacity`` ids; full
    pieces fill a sequence each, and the rest are packed first-fit decreasing.
    Groups of about ``group_rows`` documents, drawn by a seeded hash of id, text
    and number among equal rows, are packed
    independently: a group leaves few sequences part-filled, and no task holds
    more than its group however large the corpus or the copies of one text are.
    So the result doesn't depend on how the input is laid out.

    Returns one row for each piece: ``id_col``, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (group and number in the
    group) and ``offset``. Null and empty texts are documents of ``end_id``
    alone; repeated rows are packed each on its own; null ids stay null; other
    columns are ignored, whatever their names; an empty table gives no rows. The
    tokenizer's added tokens, such as those that end a text, get their own ids
    where a text spells them out.
    """
    known = cut(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    first = known.where("start = 0").select("key", "row")
    groups = max(1, -(-first.count() // group_rows))
    again = known.join(repeats(first, "key", "row", "nth"), ["key", "row"], "left")
    dealt = again.withColumn("group", F.pmod(F.xxhash64("key", F.coalesce("nth", F.lit(0).cast("long"))), F.lit(groups))).drop("key", "row", "nth")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("id", "start", "ids_crc32", "doc_tokens")])
        bins, offsets = first_fit_decreasing(rows.column("length").to_numpy(), capacity)
        sequence = (rows.column("group").to_numpy() << 32) + bins
        return rows.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    packed = dealt.groupBy("group").applyInArrow(run, f"id {dealt.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
