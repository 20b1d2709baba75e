"""SentencePiece encoding and decoding: exact merges, found by backtracking over longest matches."""

from __future__ import annotations

import codecs
import functools
import itertools
import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import slices
from lakemill.llm.keys import named

#: The mark that stands for a space, and kinds of pieces and of models as model files number them.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: What the library writes for the unknown id unless the model names something else.
UNKNOWN_SURFACE = " ⁇ "
#: Segments, and pairs of pieces, that a worker remembers; once full, both are begun again.
REMEMBERED = 400_000
#: Code points of the longest segment that is remembered.
SHORT = 64
#: Code points of a text that are split into segments at once.
STRETCH = 1 << 18


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; numbers as integers, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


class Model:
    """The pieces of a model file of the kind BPE, and how it treats spaces.

    Texts aren't normalised (a model that asks for it is refused), spaces are written as :data:`SPACE`, and one
    more is put in front. What is no piece is written in bytes.
    """

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        trainer, normalizer = {}, {}
        with open(path, "rb") as f:
            for field, value in fields(f.read()):
                if field == 1:
                    own = dict(fields(value))
                    text, kind = own.get(1, b"").decode(), own.get(3, NORMAL)
                    if kind == NORMAL:
                        self.scores[text] = struct.unpack("<f", own.get(2, bytes(4)))[0]
                        self.ids[text] = len(self.pieces)
                    self.pieces.append(text)
                    self.kinds.append(kind)
                elif field == 2:
                    trainer = dict(fields(value))
                elif field == 3:
                    normalizer = dict(fields(value))
        bytes_of = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1 and not trainer.get(24)
        if trainer.get(3, 1) != BPE or len(bytes_of) != 256 or not plain or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte pieces, spaces kept as they are and no normalisation can be used")
        self.byte_ids = [bytes_of[b] for b in range(256)]
        self.unknown = trainer[44].decode() if 44 in trainer else UNKNOWN_SURFACE
        # no piece holds a space after something else: merges never cross what lies between
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in self.scores)


class Encoder:
    """Encodes texts just as merging the best pair again and again would, without merging them.

    Best merges leave a sequence of pieces in which each two neighbours, merged
    again by themselves, come out as those two; and there is only one such
    sequence. So pieces are tried from the left, the longest first; a piece
    that isn't compatible with the one before gives way to the next shorter one that begins it; and a place
    from which nothing leads on is marked in a field of bits, so that no place
    fails twice: the time is linear in the text.
    """

    def __init__(self, model: Model):
        self.model = model
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        #: For each piece, how its last and its first symbol grow: (score of the next merge inside the piece, the symbol until then).
        self.last: dict[str, list[tuple[float, str]]] = {}
        self.first: dict[str, list[tuple[float, str]]] = {}
        self.search = ahocorasick.Automaton()
        for p in model.scores:
            # a piece that merges don't lead to is never a result
            if self._grow(p):
                self.search.add_word(p, len(p))
        self.search.make_automaton()
        #: The longest piece that begins a piece, in code points; a code point by itself always is one.
        self.shorter = {p: next((n for n in range(len(p) - 1, 1, -1) if p[:n] in self.last), 1) for p in self.last if len(p) > 1}
        self.segment = re.compile(f"{SPACE}*[^{SPACE}]*") if model.parted else re.compile(".+", re.DOTALL)

    def _grow(self, piece: str) -> bool:
        """Merge the code points of a piece, always the best pair and of equal ones the first, and note its ends; whether all become one."""
        scores, symbols, last, first = self.model.scores, list(piece), [], []
        while len(symbols) > 1:
            at = max(range(len(symbols) - 1), key=lambda i: scores.get(symbols[i] + symbols[i + 1], -math.inf))
            both = symbols[at] + symbols[at + 1]
            if both not in scores:
                return False
            last.append((scores[both], symbols[-1]))
            first.append((scores[both], symbols[0]))
            symbols[at : at + 2] = [both]
        self.last[piece], self.first[piece] = [*last, (-math.inf, piece)], [*first, (-math.inf, piece)]
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether both, merged again side by side, come out as they are.

        Each piece merges as it does by itself until the symbols at the border
        make a better pair than the next one on either side; of equal pairs the first is merged.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[left, right] = self._apart(self.last.get(left) or [(-math.inf, left)], self.first.get(right) or [(-math.inf, right)])
        return found

    def _apart(self, last: list[tuple[float, str]], first: list[tuple[float, str]]) -> bool:
        scores, i, j = self.model.scores, 0, 0
        while True:
            (a, x), (b, y) = last[i], first[j]
            across = scores.get(x + y)
            if across is not None and across > a and across >= b:
                return False
            if a >= b:
                if a == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def split(self, text: str) -> list[str]:
        """The pieces of a text in which spaces are marked; code points that no piece holds stand for themselves."""
        size = len(text)
        longest = array("L", [1]) * size
        for end, n in self.search.iter(text):
            longest[end + 1 - n] = n
        failed = bytearray(size // 8 + 1)
        out: list[str] = []
        at, n = 0, longest[0] if size else 0
        while at < size:
            while n:
                end = at + n
                piece = text[at:end]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    break
                n = self.shorter[piece] if n > 1 else 0
            if n:
                out.append(piece)
                at, n = end, longest[end] if end < size else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                n = self.shorter[piece] if len(piece) > 1 else 0
        return out

    def ids_of(self, segment: str) -> bytes:
        out, ids, letters = array("i"), self.model.ids, self.model.byte_ids
        for piece in self.split(segment):
            found = ids.get(piece)
            if found is not None:
                out.append(found)
            else:
                out.extend(letters[b] for b in piece.encode())
        return out.tobytes()

    def encode(self, text: str | None) -> array:
        """The ids of a whole text; none for a null or empty one.

        The text is cut before each run of spaces, where no merge leads across,
        and segments that come again are encoded once.
        """
        out, known = array("i"), self.known
        for part in self._stretches(text) if text else ():
            for segment in self.segment.findall(part):
                ids = known.get(segment)
                if ids is None:
                    ids = self.ids_of(segment)
                    if len(segment) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[segment] = ids
                out.frombytes(ids)
        return out

    def _stretches(self, text: str) -> Iterator[str]:
        """The text with its spaces marked, in stretches that end where segments do."""
        text = SPACE + text.replace(" ", SPACE)
        start = 0
        while start < len(text):
            stop = start + STRETCH
            if self.model.parted:
                while 0 < (stop := text.find(SPACE, stop)) and text[stop - 1] == SPACE:
                    stop += 1
            stop = stop if self.model.parted and stop > 0 else len(text)
            yield text[start:stop]
            start = stop


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Decoder:
    """Turns ids into text again."""

    def __init__(self, model: Model):
        codecs.register_error("lakemill.each_byte", _each_byte)
        self.lead = {i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL and p.startswith(SPACE)}
        self.silent = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.parts = [self._part(model, p, k) for p, k in zip(model.pieces, model.kinds, strict=True)]

    @staticmethod
    def _part(model: Model, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return {NORMAL: piece.replace(SPACE, " "), UNKNOWN: model.unknown, CONTROL: ""}[kind].encode()

    def decode(self, ids: list[int] | array | None) -> str | None:
        """The text of ``ids``: one space in front is the encoder's own, and a byte that belongs to no character is U+FFFD."""
        if ids is None:
            return None
        if not self.silent.isdisjoint(ids):
            # what stands on both sides of one makes no character together
            runs = [list(run) for silent, run in itertools.groupby(ids, self.silent.__contains__) if not silent]
        else:
            runs = [ids]
        texts = [b"".join(map(self.parts.__getitem__, run)).decode("utf-8", "lakemill.each_byte") for run in runs]
        whole = "".join(texts)
        return whole[1:] if runs and runs[0] and runs[0][0] in self.lead else whole


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Model(path))


@functools.lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(Model(path))


def encoded(path: str) -> Callable[[Column], Column]:
    """A function of a text column: the ids of each whole text by the model file at ``path``; none for null and empty texts."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for batch in texts:
            done = [pa.array([], pa.list_(pa.int32()))]
            for part in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                flat, ends = array("i"), array("i", [0])
                for text in part.column(0):
                    flat.extend(own.encode(text.as_py()))
                    ends.append(len(flat))
                done.append(pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32())))
            yield pa.concat_arrays(done)

    # so that no rule of the optimizer has it run twice
    call = F.arrow_udf(run, "array<int>").asNondeterministic()
    return lambda text: call(text.cast("string"))


def decoded(path: str) -> Callable[[Column], Column]:
    """A function of a column of ids (array of int): the text of each; null for null. Ids that the model doesn't have are an error."""

    def run(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = decoder(path)
        for batch in lists:
            yield pa.array([own.decode(x.values.to_numpy().tolist() if x.is_valid else None) for x in batch], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``ids``): the ids of every whole text, by the SentencePiece model file at ``path``.

    Ids are those of the library's plain call: no begin or end ids, no
    sampling. Null and empty texts have no ids; very long ones are gone through
    in stretches, and a long run without spaces in time linear in its length. A row for each row, so repeated rows are
    encoded alike and null ids are ids like others; other columns don't matter,
    and an empty table gives none. Texts go through Python once,
    without a shuffle.
    """
    return docs.select(named(id_col).alias(id_col), encoded(path)(named(text_col)).alias("ids"))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``rows``' ``id_col`` and ``ids_col`` with ``text``, what the ids stand for: null for null, empty for none."""
    return rows.select(named(id_col).alias(id_col), named(ids_col).alias(ids_col), decoded(path)(named(ids_col)).alias("text"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, and the SHA-256 of the ids, joined by commas, and of the text that they are decoded to."""
    both = decode(encode(docs, path, id_col, text_col), path, id_col)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(named(id_col), F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
