"""Whether words are of any language that was learned: character models, judged by words that they haven't seen."""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import NOT_LETTERS, flat, slices, split
from lakemill.llm.storage import cut

#: Longest n-gram of the character models.
LONGEST = 4
#: Characters that a language might have: what it has never used shares the chance left for new ones.
CHARACTERS = 1 << 16
#: Words of a block, which fits a learned language or doesn't.
BLOCK = 8
#: A block doesn't fit below this quantile of blocks of held-back words, and this many deviations below their mean.
QUANTILE, DEVIATIONS = 0.001, 5.0
#: How far below the limit of one word the mean log-likelihood of a word's letters counts.
BELOW = 0.1
#: Blocks of held-back words that a limit is taken from at least.
LEAST_BLOCKS = 30
#: Bins of log-likelihoods, to the unit.
BINS = 1024
#: N-grams of a model; only where more are used, those used least are left to shorter ones.
MOST_GRAMS = 1 << 19
#: Words of a vocabulary that are scored at once.
WORDS_AT_ONCE = 8192


@dataclasses.dataclass
class Table:
    """N-grams of one length: hashes in order, and for each language the log-probability of the last letter after the others, and what a letter costs that never followed."""

    hashes: np.ndarray
    found: np.ndarray
    missed: np.ndarray

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash; one past the end, where a miss costs nothing, if there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))


def _grams(vocabulary: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For words between boundary marks: hashes of n-grams by the place of their last letter, places in words, sizes."""
    marked = pc.binary_join_element_wise("<", vocabulary, ">", "")
    sizes = pc.utf8_length(marked).to_numpy().astype(np.int64)
    codes = np.frombuffer(flat(marked)[0].tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = [codes]
    for _ in range(1, LONGEST):
        h = np.zeros_like(codes)
        h[1:] = hashes[-1][:-1]
        hashes.append(h * np.uint64(0x9E3779B97F4A7C15) + codes)
    return hashes, place, sizes


@dataclasses.dataclass
class Familiar:
    """Character models of the languages learned (``tables``, and ``unseen`` for new letters), and the least mean log-likelihood of a letter in blocks of 1 to ``BLOCK`` words."""

    tables: list[Table]
    unseen: np.ndarray
    limits: np.ndarray

    def scores(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The log-likelihood of each word in the language that it is likeliest in, and its letters with its end."""
        out, letters = np.empty(len(vocabulary)), np.empty(len(vocabulary))
        for start in range(0, len(vocabulary), WORDS_AT_ONCE):
            hashes, place, sizes = _grams(vocabulary[start : start + WORDS_AT_ONCE])
            logs, rest = np.zeros((len(place), len(self.unseen)), dtype=np.float32), place > 0
            # the longest n-gram counted says it all; each longer one adds what it costs not to be there
            for n in range(LONGEST - 1, -1, -1):
                at = np.flatnonzero(rest & (place >= n))
                row = self.tables[n].find(hashes[n][at])
                hit = row < len(self.tables[n].hashes)
                logs[at[hit]] += self.tables[n].found[row[hit]]
                rest[at[hit]] = False
                at = at[~hit]
                logs[at] += self.tables[n - 1].missed[self.tables[n - 1].find(hashes[n - 1][at - 1])] if n else self.unseen
            out[start : start + len(sizes)] = np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0).max(axis=1)
            letters[start : start + len(sizes)] = sizes - 1
        return out, letters

    def share(self, vocabulary: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The share of each text's words that stand in blocks that fit; ``counts`` (all above zero) are words of texts."""
        if not len(counts):
            return np.zeros(0)
        per = -(-counts // BLOCK)
        size = np.full(int(per.sum()), BLOCK)
        size[np.cumsum(per) - 1] = counts - (per - 1) * BLOCK
        fits = block_means(*bounded(*self.scores(vocabulary), self.limits[0]), ids, size) >= self.limits[size - 1]
        return np.add.reduceat(fits * size, np.cumsum(per) - per) / counts


def bounded(scores: np.ndarray, letters: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores that are no worse than just below the limit of one word: a single name in other letters says little of its block."""
    return np.maximum(scores, (limit - BELOW) * letters), letters


def block_means(scores: np.ndarray, letters: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean log-likelihood of a letter in blocks of ``sizes`` words in a row."""
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(scores[ids], starts) / np.add.reduceat(letters[ids], starts)


@dataclasses.dataclass
class Level:
    """Counted n-grams of one length: hashes in order, hashes of the n-gram without its last and without its first letter, and uses in each language."""

    hashes: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    seen: np.ndarray


def smoothed(levels: list[Level]) -> Familiar:
    """Character models of counted n-grams, smoothed by Witten and Bell's rule; without limits."""
    k = levels[0].seen.shape[1]
    tables: list[Table] = []
    chance, unseen = np.zeros((0, k)), np.zeros(k)
    for n, level in enumerate(levels):
        context = np.searchsorted(tables[-1].hashes, level.context) if n else np.zeros(len(level.hashes), dtype=np.int64)
        contexts = len(tables[-1].hashes) if n else 1
        followed, kinds = (np.stack([np.bincount(context, x[:, j], contexts) for j in range(k)], axis=1) for x in (level.seen, level.seen > 0))
        kinds = np.maximum(kinds, 1)
        left = kinds / (followed + kinds)
        chance = level.seen / (followed + kinds)[context] + left[context] * (chance[np.searchsorted(tables[-1].hashes, level.shorter)] if n else 1 / CHARACTERS)
        if n:
            tables[-1].missed[:-1] = np.log(left)
        else:
            unseen = np.log(left[0] / CHARACTERS)
        tables.append(Table(level.hashes, np.log(chance).astype(np.float32), np.zeros((len(level.hashes) + 1, k), dtype=np.float32)))
    return Familiar(tables, unseen.astype(np.float32), np.full(BLOCK, -np.inf))


def grams(words: pa.Array, kind: np.ndarray, kinds: int, times: np.ndarray) -> Iterator[tuple[Level, np.ndarray]]:
    """N-grams of words that are of one of ``kinds`` and used so many ``times``, by length: their uses, and whether a kind has them at all."""
    hashes, place, sizes = _grams(words)
    kind = np.repeat(kind, sizes)
    # an opening mark is never predicted
    times = np.repeat(times.astype(np.float64), sizes) * (place > 0)
    for n in range(LONGEST):
        at = np.flatnonzero(place >= n)
        keys, where, row = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        where, cell = at[where], row * kinds + kind[at]
        before = hashes[n - 1] if n else np.zeros_like(hashes[0])
        seen, there = (np.bincount(cell, x, len(keys) * kinds).reshape(-1, kinds) for x in (times[at], None))
        yield Level(keys, before[where - 1], before[where], seen), there > 0


def learn(spans: list[tuple[str, str]]) -> Familiar:
    """Character models of (language, words) spans; without limits."""
    langs = sorted({lang for lang, _ in spans})
    uses = Counter((lang, w) for lang, text in spans for w in text.split(" "))
    kind, times = np.array([langs.index(x) for x, _ in uses]), np.fromiter(uses.values(), dtype=np.int64)
    return smoothed([level for level, _ in grams(pa.array([w for _, w in uses], pa.string()), kind, len(langs), times)])


def fit(spans: list[tuple[str, str, bool]]) -> Familiar | None:
    """Character models of all (language, words, held back) spans; None if there are too few to set limits.

    Limits come from the spans held back, under models of the others: what was
    learned from fits better than new text does.
    """
    spans = [s for s in spans if s[1]]
    seen = [(lang, text) for lang, text, back in spans if not back]
    # where the others have nothing of a language, nothing is said about it
    known = {lang for lang, _ in seen}
    back = [text.split(" ") for lang, text, back in spans if back and lang in known]
    if not seen or sum(map(len, back)) < LEAST_BLOCKS:
        return None
    model, limits = learn(seen), np.full(BLOCK, -np.inf)
    coded = pa.array([w for words in back for w in words], pa.string()).dictionary_encode()
    scores, letters = model.scores(coded.dictionary)
    ids, lengths = coded.indices.to_numpy(), np.array([len(words) for words in back])
    for n in range(1, BLOCK + 1):
        starts = np.concatenate([np.arange(end - size, end - n + 1, n) for end, size in zip(np.cumsum(lengths), lengths, strict=True)])
        if len(starts) < LEAST_BLOCKS:
            limits[n - 1] = limits[n - 2]
            continue
        means = block_means(scores, letters, ids[(starts[:, None] + np.arange(n)).ravel()], np.full(len(starts), n))
        # words that don't fit one by one don't fit together
        limits[n - 1] = max(limits[0], min(np.quantile(means, QUANTILE), means.mean() - DEVIATIONS * means.std()))
        if n == 1:
            scores, letters = bounded(scores, letters, limits[0])
    return dataclasses.replace(learn([(lang, text) for lang, text, _ in spans]), limits=limits)


def count_grams(counts: DataFrame, langs: list[str], most: int = MOST_GRAMS) -> list[tuple[Level, np.ndarray]]:
    """The n-grams of all counted words (``word``, ``lang``, ``back``, ``n``), by length: uses in words not held back, and in those that are.

    They are counted by Spark. Of more than ``most`` n-grams those used least
    are left out of the model, so that its size has a bound: shorter ones stand for them, which
    are used at least as often.
    """
    k = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "word"):
                kind = pc.index_in(one.column("lang"), value_set=pa.array(langs)).to_numpy() * 2 + one.column("back").to_numpy(zero_copy_only=False)
                for n, (level, there) in enumerate(grams(one.column("word"), kind, 2 * k, one.column("n").to_numpy())):
                    row, of = np.nonzero(there)
                    values = [np.full(len(row), n, dtype=np.int32), *(x[row].view(np.int64) for x in (level.hashes, level.context, level.shorter)), of.astype(np.int32), level.seen[row, of].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["level", "h", "context", "shorter", "kind", "n"])

    found = counts.mapInArrow(run, "level int, h long, context long, shorter long, kind int, n long")
    both = F.min("context").alias("context"), F.min("shorter").alias("shorter")
    uses = [F.coalesce(F.sum(F.when(F.col("kind") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(2 * k)]
    table = cut(found.groupBy("level", "h").agg(*both, *uses, F.sum("n").alias("n")), "grams")
    least = 0
    # an opening mark alone has no uses, and is the start of others
    while (kept := table.where((F.col("n") >= least) | (F.col("n") == 0))).count() > most:
        least = max(2, 2 * least)
    got = kept.toArrow()
    level, h, context, shorter = (got.column(c).to_numpy() for c in ("level", "h", "context", "shorter"))
    seen = np.stack([got.column(f"n{i}").to_numpy() for i in range(2 * k)], axis=1).astype(np.float64)
    out = []
    for n in range(LONGEST):
        at = np.flatnonzero(level == n)
        at = at[np.argsort(h[at].view(np.uint64))]
        out.append((Level(*(x[at].view(np.uint64) for x in (h, context, shorter)), seen[at, ::2]), seen[at, 1::2]))
    return out


def limit_of(bins: np.ndarray, uses: np.ndarray, total: float, squares: float) -> float:
    """The limit that values counted in bins set: their quantile, by the lower end of its bin, or what lies so many deviations below their mean."""
    order = np.argsort(bins)
    n = uses.sum()
    at = np.searchsorted(np.cumsum(uses[order]), QUANTILE * (n - 1), side="right")
    mean = total / n
    return min(bins[order][at] / BINS, mean - DEVIATIONS * np.sqrt(max(0.0, squares / n - mean**2)))


def binned(n: np.ndarray, means: np.ndarray, uses: np.ndarray) -> pa.RecordBatch:
    """Means of blocks of ``n`` words: how many are in each bin, with their sum and sum of squares."""
    bins = np.floor(means * BINS).astype(np.int64)
    keys, row = np.unique(np.stack([n, bins]), axis=1, return_inverse=True) if len(n) else (np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
    sums = [np.bincount(row.ravel(), x, keys.shape[1]) for x in (uses, uses * means, uses * means**2)]
    return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["size", "bin", "uses", "total", "squares"])


def _limits(parts: DataFrame) -> dict[int, tuple[int, float]]:
    """For each number of words the blocks counted, and the limit that they set."""
    got = parts.groupBy("size", "bin").agg(*(F.sum(c).alias(c) for c in ("uses", "total", "squares"))).orderBy("size", "bin").toArrow()
    size, bins, uses, total, squares = (got.column(c).to_numpy() for c in ("size", "bin", "uses", "total", "squares"))
    return {int(n): (int(uses[at].sum()), limit_of(bins[at], uses[at], total[at].sum(), squares[at].sum())) for n in np.unique(size) for at in [size == n]}


def fit_all(texts: DataFrame, counts: DataFrame, langs: list[str]) -> Familiar | None:
    """:func:`fit` on all of ``texts`` (``lang``, ``text``, ``back``), whose words are in ``counts``, as Spark jobs; quantiles are found in bins of 1/1024."""
    levels = count_grams(counts, langs)
    first, others = levels[0]
    known = np.flatnonzero(first.seen.sum(axis=0))
    if not len(known) or not others[:, known].any():
        return None
    # n-grams that only words held back have are not in the model of the others; an opening mark has no uses
    seen = [(level, level.seen.any(axis=1) | ~back.any(axis=1)) for level, back in levels]
    model = smoothed([Level(level.hashes[a], level.context[a], level.shorter[a], level.seen[a][:, known]) for level, a in seen])
    schema, session = "size long, bin long, uses long, total double, squares double", counts.sparkSession
    shared = session.sparkContext.broadcast(model)
    is_known = F.col("back") & F.col("lang").isin([langs[i] for i in known])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "word"):
                scores, letters = shared.value.scores(one.column("word"))
                yield binned(np.ones(len(scores), dtype=np.int64), scores / letters, one.column("n").to_numpy())

    single = _limits(counts.where(is_known).mapInArrow(words, schema))
    if single[1][0] < LEAST_BLOCKS:
        return None
    limits = np.full(BLOCK, single[1][1])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "text"):
                ids, vocabulary, sizes = split(one.column("text"), NOT_LETTERS)
                scores, letters = (np.concatenate([[0.0], np.cumsum(x[ids])]) for x in bounded(*shared.value.scores(vocabulary), limits[0]))
                first, found = np.cumsum(sizes) - sizes, []
                for n in range(2, BLOCK + 1):
                    per = sizes // n
                    start = np.repeat(first - (np.cumsum(per) - per) * n, per) + np.arange(per.sum()) * n
                    found.append((scores[start + n] - scores[start]) / (letters[start + n] - letters[start]))
                yield binned(np.repeat(np.arange(2, BLOCK + 1), [len(x) for x in found]), np.concatenate(found), np.ones(sum(map(len, found))))

    more = _limits(texts.where(is_known).select("text").mapInArrow(blocks, schema)) if BLOCK > 1 else {}
    shared.unpersist()
    for n in range(2, BLOCK + 1):
        uses, limit = more.get(n, (0, 0.0))
        limits[n - 1] = limits[n - 2] if uses < LEAST_BLOCKS else max(limits[0], limit)
    return dataclasses.replace(smoothed([dataclasses.replace(level, seen=level.seen + back) for level, back in levels]), limits=limits)
