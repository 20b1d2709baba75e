"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import slices
from lakemill.llm.keys import named

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
HEX = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Fixed values: (kind, expression matched at a hit, shortest accepted length, group that it holds for).
PATTERNS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 6, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 24, 0),
    "github": (re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), 40, 0),
    "npm": (re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), 40, 0),
}
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")


def _cases(word: str) -> Iterator[str]:
    """The word with each letter in either case."""
    return map("".join, itertools.product(*({c.lower(), c.upper()} for c in word)))


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """One automaton over whole keywords; a value is (kind, keyword length).

    A run of 24 hexadecimal digits has no keyword, so all groups of four such
    digits serve as its keywords: prose seldom has one.
    """
    found = ahocorasick.Automaton()
    keys = [("assign", k) for word in ASSIGNED for k in _cases(word)]
    keys += [("access", "AKIA"), ("npm", "npm_"), *(("github", f"gh{c}_") for c in "pousr")]
    keys += [("hex", "".join(k)) for k in itertools.product(HEX, repeat=4)]
    for kind, key in keys:
        found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def checksum_holds(body: str, check: str) -> bool:
    """Whether ``check`` is the CRC-32 of ``body`` in six base-62 digits."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode("ascii"))


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then as kinds are listed.

    A match uses up its text whether or not it is accepted, as a scan from left
    to right does. Tokens of the kinds github and npm count only if their last
    six characters are the checksum of the thirty before.
    """
    out = []
    after = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton().iter(text):
        start = last - length + 1
        if start < after[kind]:
            continue
        pattern, least, group = PATTERNS[kind]
        m = pattern.match(text, start)
        if m is None:
            continue
        after[kind] = m.end()
        if m.end(group) - m.start(group) < least or (kind not in BASE and not checksum_holds(m[1], m[2])):
            continue
        out.append((start, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by ``[SECRET]``."""
    parts, at = [], 0
    for start, end, _ in found:
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    for batch in texts:
        done = []
        for part in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
            own = part.column(0).to_pylist()
            found = [spans(t) if t else [] for t in own]
            rows = [[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found]
            sums = [hashlib.sha256(listed([s for s in f if s[2] in BASE]).encode()).hexdigest() for f in found]
            clean = [redact(t, f) if f else None for t, f in zip(own, found, strict=True)]
            done.append(pa.StructArray.from_arrays([pa.array(rows, span), pa.array(sums, pa.string()), pa.array(clean, pa.string())], ["spans", "base_sha256", "redacted"]))
        yield pa.concat_arrays(done) if done else pa.array([], pa.struct([("spans", span), ("base_sha256", pa.string()), ("redacted", pa.string())]))


def scanned(text: Column) -> Column:
    """What :func:`scan` finds in a text column, as a struct; ``redacted`` is null where there is nothing to redact."""
    kind = "struct<spans: array<struct<start: long, end: long, kind: string>>, base_sha256: string, redacted: string>"
    # so that no rule of the optimizer has it run twice
    return F.arrow_udf(_scanned, kind).asNondeterministic()(text.cast("string"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text, one row for each row of ``docs``.

    Returns ``id_col``, ``spans`` (array of start, end, kind; code points, end
    exclusive), ``base_sha256`` and ``redacted``, the text with spans redacted
    (null for a null text, which has no spans). Texts alone go through Python,
    in one pass without a shuffle, so repeated rows, null ids and other columns
    don't matter, and an empty table gives an empty one.

    All keywords are found in one pass over the text; an expression is tried
    only at a hit, anchored there, and reads on to the end of its match.
    """
    text = named(text_col).cast("string")
    found = docs.select(named(id_col).alias(id_col), text.alias("_text"), scanned(text).alias("_found"))
    return found.select(named(id_col), F.col("_found.spans").alias("spans"), F.col("_found.base_sha256").alias("base_sha256"), F.coalesce("_found.redacted", "_text").alias("redacted"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of base spans and the list of all spans, per row."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    text = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    return scan(docs, id_col, text_col).select(id_col, count("assign"), count("access"), count("hex"), "base_sha256", text.alias("spans"))
