"""URL filters: a cascade of Bloom filters that is exact on the corpus's keys."""

from __future__ import annotations

import copy
import dataclasses
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.keys import named

#: Unlisted keys of the universe that level 1 lets through on average, for each listed key.
SURVIVORS = math.sqrt(0.5)


@dataclasses.dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths with this prefix."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return f"{self.host}{self.path}"


@dataclasses.dataclass(frozen=True)
class Level:
    """A Bloom filter: ``size`` bits, eight to a byte."""

    bits: bytes
    size: int
    hashes: int

    @staticmethod
    def of(keys: Iterable[str], rate: float, seed: int) -> Level:
        keys = list(keys)
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        level, marks = Level(b"", size, max(1, round(-math.log2(rate)))), np.zeros(size, dtype=bool)
        for key in keys:
            marks[level.places(key, seed)] = True
        return dataclasses.replace(level, bits=np.packbits(marks, bitorder="little").tobytes())

    def places(self, key: str, seed: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), seed)
        a, b = h >> 64, (h & 0xFFFFFFFFFFFFFFFF) | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def has(self, key: str, seed: int) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key, seed))


class Cascade:
    """Levels that encode listed keys, then level 1's false positives, then level 2's, and so on.

    A key passes levels until one rejects it; it is listed if an odd number of
    levels passed it. That is exact for every key of the universe from which the
    false positives were taken. Level 1 lets about 0.7 keys through for each
    listed key, and each later level half of what it is asked, so all levels
    together take about a byte for each listed key whatever the corpus's size
    but for its logarithm. The levels are all that a cascade holds.
    """

    def __init__(self, listed: Iterable[str], universe: int):
        listed = frozenset(listed)
        rate = SURVIVORS * max(1, len(listed)) / max(1, universe)
        self.levels = [Level.of(listed, min(0.5, rate), 0)]

    def passes_first(self, key: str) -> bool:
        return self.levels[0].has(key, 0)

    def close(self, listed: Iterable[str], survivors: Iterable[str]) -> Cascade:
        """Add levels until none has a false positive; ``survivors``: keys of the universe that pass level 1, listed ones or not."""
        inside = frozenset(listed)
        wrong = frozenset(survivors) - inside
        while wrong:
            seed = len(self.levels)
            level = Level.of(wrong, 0.5, seed)
            inside, wrong = wrong, frozenset(k for k in inside if level.has(k, seed))
            self.levels = [*self.levels, level]
        return self

    def __contains__(self, key: str) -> bool:
        passed = 0
        while passed < len(self.levels) and self.levels[passed].has(key, passed):
            passed += 1
        return passed % 2 == 1

    @property
    def size(self) -> int:
        """Bytes of all levels."""
        return sum(len(level.bits) for level in self.levels)


@dataclasses.dataclass(frozen=True)
class Shape:
    """How long listed hosts and paths are: nothing longer is looked up."""

    labels: int
    characters: int
    paths: tuple[int, ...]

    @staticmethod
    def of(rules: Iterable[Rule]) -> Shape:
        rules = list(rules)
        return Shape(max((r.host.count(".") + 1 for r in rules), default=0), max((len(r.host) for r in rules), default=0), tuple(sorted({len(r.path) for r in rules}, reverse=True)))

    def keys(self, host: str, path: str) -> list[str]:
        """Keys of all rules that could fit, the longest first: what the cascade is asked."""
        # only the end of a host, however long that is, can be a listed host with a dot before it
        end = host[-self.characters - 1 :] if self.characters else ""
        labels = end.rsplit(".", self.labels)
        hosts = (".".join(labels[i:]) for i in range(0 if len(labels) <= self.labels and len(end) == len(host) else 1, len(labels)))
        return sorted((h + path[:n] for h in hosts if len(h) <= self.characters for n in self.paths if len(path) >= n), key=len, reverse=True)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    found = F.regexp_extract(rest_of(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """The longest rule that fits each URL, and its verdict.

    The keys of a URL are its host's suffixes at dots, none longer than the
    longest listed host, with its path's prefixes
    of the lengths that rules have; the universe is the keys of all URLs.
    One pass finds the keys that pass level 1, about 0.7 for
    each rule besides the rules' own; a second walks the cascade. No row is
    shuffled or joined. A URL that no rule fits has no listed key: its ``rule`` is null
    and its verdict ``default``.

    Workers get the levels of two cascades, broadcast, and no key: one says
    which keys are listed, and one, whose universe is the list, which of those
    block. The key that is found is the rule.

    Returns ``id_col``, ``host``, ``path``, ``rule`` and ``verdict``, a row for
    each row. Null URLs and those without ``://`` have an empty host and path; a URL may be of any length.
    Repeated rows, null ids and other columns don't matter; an empty table gives
    no rows. The rule with the longest host and path together wins; of two rules
    with one key the last counts. ``rules`` is a list on the driver, so its size is
    known before cascades are made.
    """
    verdicts = {r.key: r.verdict for r in rules}
    shape = Shape.of(rules)
    url = named(url_col).cast("string")
    split = pages.select(named(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    spark = pages.sparkSession
    cascade = Cascade(verdicts, split.count() * max(1, shape.labels * len(shape.paths)))
    first = spark.sparkContext.broadcast(cascade)

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True) for k in shape.keys(h, p) if first.value.passes_first(k)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["key"])

    passed = split.select("host", "path").mapInArrow(survivors, "key string").distinct()
    blocked = [k for k, v in verdicts.items() if v == "block"]
    # level 1 has been sent already: what is added to it goes with a copy
    listed = spark.sparkContext.broadcast(copy.copy(cascade).close(verdicts, (r.key for r in passed.collect())))
    inner = Cascade(blocked, len(verdicts))
    blocks = spark.sparkContext.broadcast(inner.close(blocked, (k for k in verdicts if inner.passes_first(k))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [next((k for k in shape.keys(h, p) if k in listed.value), None) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            said = [default if f is None else "block" if f in blocks.value else "allow" for f in fits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fits, pa.string()), pa.array(said, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(apply, f"id {split.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
