"""Language ID of code-switched text: a linear-chain conditional random field over words."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import familiarity
from lakemill.llm.arrowtext import NOT_LETTERS, flat, slices, split, word_hashes
from lakemill.llm.keys import named
from lakemill.llm.quality import add_up
from lakemill.llm.storage import cut, drop

#: Words that touch no digits: pieces of numbers and keys aren't of any language.
NOT_PLAIN = r"(?:\p{L}*\p{N}[\p{L}\p{N}]*|[^\p{L}\p{N}]+)+"
#: Weights of n-gram and affix features: a power of two.
BUCKETS = 1 << 16
#: Longest n-gram and affix, in letters.
LONGEST = 4
#: Shares of a word's uses in its main language at which lexicon features part.
CONFIDENCE = (0.5, 0.7, 0.9, 0.99)
#: Lexicon entries, which words share by their hash: a power of two.
ENTRIES = 1 << 19
#: Words of a chain that is learned from, and chains of a step.
CHAIN, CHAINS = 32, 256
#: One word in so many is followed by a switch to some language.
SWITCH = 16
#: Steps that weights are learned in at least: few words are gone through again and again.
STEPS = 80
#: Words of a task that learns: at least, while there are fewer tasks than ``SPREAD``, and at most.
FEWEST, MOST, SPREAD = 250_000, 4_000_000, 16
#: Length of a step.
RATE = 0.1
#: Letters of a vocabulary that have their features in memory at once, but for a longer word.
LETTERS_AT_ONCE = 1 << 16
#: Bytes of counted words that a task adds up before Spark does.
TALLIED = 32_000_000
#: Words of a block: blocks of all chains are worked through side by side.
BLOCK = 64
#: Words of a chain that are held in memory at once, with their messages.
PIECE = 500_000


@dataclasses.dataclass
class Model:
    """Learned values: languages, feature weights, transitions, lexicon (hash of a word to feature) and its weights."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray

    def emissions(self, vocabulary: pa.Array) -> np.ndarray:
        """The score of each word of a vocabulary for each language."""
        out = np.empty((len(vocabulary), len(self.langs)))
        for at, features in features_by_length(vocabulary):
            out[at] = self.weights.take(features, axis=0).sum(axis=0)
        return out + self.lexicon_weights.take(self.lexicon[entry(vocabulary)], axis=0)


def entry(words: pa.Array) -> np.ndarray:
    """The entry of the lexicon that each word has."""
    return (word_hashes(words) >> np.uint64(64 - ENTRIES.bit_length() + 1)).astype(np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` (all above zero) at a time."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, *values.shape[1:]), dtype=values.dtype)


def features_by_length(vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of words, some words of one length at a time: their places in the vocabulary, and a column of features for each.

    A word stands between two boundary marks; its features are all n-grams of up
    to ``LONGEST`` characters (single marks aside) and, as features of their
    own, the prefixes and suffixes of up to ``LONGEST`` letters.
    """
    marked = pc.binary_join_element_wise("<", vocabulary, ">", "")
    sizes = pc.utf8_length(marked).to_numpy().astype(np.int64)
    codes = np.frombuffer(flat(marked)[0].tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    first, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    by, prime = sizes[order], 0x100000001B3
    start = 0
    while start < len(order):
        size = int(by[start])
        at = order[start : min(int(np.searchsorted(by, size, side="right")), start + max(1, LETTERS_AT_ONCE // size))]
        start += len(at)
        letters = codes[first[at] + np.arange(size)[:, None]].astype(np.uint64)
        found, run = [], letters
        for n in range(1, min(size, LONGEST + 1) + 1):
            if n > 1:
                run = run[:-1] * np.uint64(prime) + letters[n - 1 :]
            h = run + np.uint64(n * prime**n % (1 << 64))
            if n <= LONGEST:
                found.append(h if n > 1 else h[1:-1])
            if n > 1:
                found += [h[:1] * np.uint64(31) + np.uint64(1), h[-1:] * np.uint64(31) + np.uint64(2)]
        h = np.concatenate(found)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(64 - BUCKETS.bit_length() + 1)
        yield at, h.view(np.int64)


def features_of(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (:func:`features_by_length`) of all words in a row, and how many each word has."""
    parts = [(at, features.astype(np.int32)) for at, features in features_by_length(vocabulary)]
    counts = np.zeros(len(vocabulary), dtype=np.int64)
    for at, features in parts:
        counts[at] = len(features)
    first, out = np.cumsum(counts) - counts, np.empty(counts.sum(), dtype=np.int64)
    for at, features in parts:
        out[first[at] + np.arange(len(features))[:, None]] = features
    return out, counts


def _grid(likely: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Likelihoods of chains cut into blocks, those of most words first, (state, slot, block), with each word's cell (slot and block), blocks of chains and, by block, in chains' order, its place.

    Words of blocks fall, so that blocks with a word at a slot are the first ones.
    """
    per = -(-counts // BLOCK)
    used = np.full(int(per.sum()), BLOCK)
    used[np.cumsum(per) - 1] = counts - (per - 1) * BLOCK
    place = np.empty(len(used), dtype=np.int64)
    place[np.argsort(-used, kind="stable")] = np.arange(len(used))
    inside = np.arange(len(likely)) - np.repeat(np.cumsum(used) - used, used)
    cell = inside * len(used) + np.repeat(place, used)
    grid = np.ones((likely.shape[1], BLOCK * len(used)))
    for state, values in zip(grid, likely.T, strict=True):
        state[cell] = values
    return grid.reshape(likely.shape[1], BLOCK, len(used)), cell, per, place


def _live(cell: np.ndarray, blocks: int) -> list[int]:
    """How many blocks have a word at each slot that any has one at."""
    return np.bincount(cell // blocks).tolist() if len(cell) else []


def _products(grid: np.ndarray, live: list[int], step: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The product of each block's step matrices, in chains' order: from the state before it to its last word."""
    k, _, blocks = grid.shape
    into, product = step.T.copy(), np.broadcast_to(np.eye(k)[:, :, None], (k, k, blocks)).copy()
    for s, m in enumerate(live):
        p = (into @ product[:, :, :m].reshape(k, -1)).reshape(k, k, m)
        p *= grid[:, s, None, :m]
        product[:, :, :m] = p / p.sum(axis=(0, 1))
    return product.transpose(2, 1, 0)[place]


def likelihoods(scores: np.ndarray) -> np.ndarray:
    """What the scores of words make of their states, 1 for the likeliest."""
    return np.exp(scores - scores.max(axis=1, keepdims=True))


def marginals(scores: np.ndarray, transitions: np.ndarray, counts: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """The probability of each state at each word of chains in a row, by forward-backward, of words' ``scores``: see :func:`passes`."""
    return passes(likelihoods(scores), np.exp(transitions - transitions.max()), counts, first, last).T


def passes(likely: np.ndarray, step: np.ndarray, counts: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """The probability of each state, a row for each, at each word of chains in a row, by forward-backward.

    Exact for chains of any length: chains are cut into blocks, the product of
    each block's step matrices carries messages over the blocks, and all blocks
    of all chains are worked through side by side. ``counts``: words of each
    chain, above zero. Every chain starts from a uniform state before its first
    word, or from the message ``first``; ``last`` is the message from after its end.
    """
    k = likely.shape[1]
    grid, cell, per, place = _grid(likely, counts)
    live = _live(cell, len(place))
    before, after = np.full((len(place), k), 1 / k), np.ones((len(place), k))
    start = np.cumsum(per) - per
    if first is not None:
        before[start] = first
    if last is not None:
        after[start + per - 1] = last
    if per.max(initial=1) > 1:
        product = _products(grid, live, step, place)
        order = np.argsort(-per, kind="stable")
        for b in range(1, int(per.max())):
            at = start[order[: int((per > b).sum())]] + b
            x = np.einsum("ni,nij->nj", before[at - 1], product[at - 1])
            before[at] = x / x.sum(axis=1, keepdims=True)
        for b in range(int(per.max()) - 2, -1, -1):
            at = start[order[: int((per > b + 1).sum())]] + b
            x = np.einsum("nij,nj->ni", product[at + 1], after[at + 1])
            after[at] = x / x.sum(axis=1, keepdims=True)
    both, into, messages = np.empty_like(grid), step.T.copy(), np.empty((k, len(place)))
    messages[:, place] = before.T
    for s, m in enumerate(live):
        x = into @ messages[:, :m]
        x *= grid[:, s, :m]
        x /= x.sum(axis=0)
        both[:, s, :m] = messages[:, :m] = x
    messages[:, place] = after.T
    for s in range(len(live) - 1, -1, -1):
        x = messages[:, : live[s]]
        both[:, s, : live[s]] *= x
        x = step @ (grid[:, s, : live[s]] * x)
        messages[:, : live[s]] = x / x.sum(axis=0)
    out = both.reshape(k, -1).take(cell, axis=1)
    out /= out.sum(axis=0)
    return out


def likeliest(p: np.ndarray) -> np.ndarray:
    """The row of the greatest value in each column, the first of equal ones."""
    top, out = p[0].copy(), np.zeros(p.shape[1], dtype=np.int64)
    for j in range(1, len(p)):
        out[p[j] > top] = j
        np.maximum(top, p[j], out=top)
    return out


def decode(emissions: np.ndarray, ids: np.ndarray, counts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each chain's marginals, and the likeliest state of each word; ``emissions[ids]`` are the words' scores.

    A chain longer than ``PIECE`` is gone through twice, piece by piece: for the
    products that carry messages between pieces, then for the marginals.
    """
    step, likely = np.exp(transitions - transitions.max()), likelihoods(emissions)
    if counts.max(initial=0) <= PIECE:
        p = passes(likely.take(ids, axis=0), step, counts)
        totals = np.add.reduceat(p, np.cumsum(counts) - counts, axis=1) if len(counts) else p
        return (totals / counts).T, likeliest(p)
    means, states = [], []
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        parts = [ids[a : min(end, a + PIECE)] for a in range(end - n, end, PIECE)]
        carry = []
        for part in parts:
            whole = np.eye(len(step))
            grid, cell, _, place = _grid(likely[part], np.array([len(part)]))
            for p in _products(grid, _live(cell, len(place)), step, place):
                whole = whole @ p
                whole /= whole.sum()
            carry.append(whole)
        first, last = [np.full(len(step), 1 / len(step))], [np.ones(len(step))]
        for p, q in zip(carry[:-1], carry[:0:-1], strict=True):
            first.append(first[-1] @ p)
            last.append(q @ last[-1])
            first[-1], last[-1] = first[-1] / first[-1].sum(), last[-1] / last[-1].sum()
        total = np.zeros(len(step))
        for part, f, e in zip(parts, first, last[::-1], strict=True):
            p = passes(likely[part], step, np.array([len(part)]), f[None], e[None])
            total += p.sum(axis=1)
            states.append(likeliest(p).astype(np.int16))
        means.append(total / n)
    return np.array(means), np.concatenate(states)


def chained(text: pa.RecordBatch, langs: list[str], random: np.random.Generator) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All words of texts as one row of spliced chains: vocabulary, words, languages, and whether their texts are of the half held back.

    Texts are strung together by language, in random order, and cut at random places, one word in ``SWITCH``; the
    pieces are shuffled, so that switches are seen. Every word is there once, but for
    those that fill up the last chain.
    """
    ids, vocabulary, sizes = split(text.column("text"), NOT_LETTERS)
    if not len(ids):
        return vocabulary, ids, ids, ids
    lang = pc.index_in(text.column("lang"), value_set=pa.array(langs)).to_numpy()
    order = np.lexsort((random.random(len(sizes)), lang))
    first, per = (np.cumsum(sizes) - sizes)[order], sizes[order]
    at = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(len(ids))
    state = np.repeat(lang[order], per)
    new = random.random(len(ids)) < 1 / SWITCH
    new[1:] |= state[1:] != state[:-1]
    new[0] = True
    start = np.flatnonzero(new)
    length = np.diff([*start, len(ids)])
    shuffled = random.permutation(len(start))
    length = length[shuffled]
    moved = np.repeat(start[shuffled] - (np.cumsum(length) - length), length) + np.arange(len(ids))
    moved = np.resize(moved, -(-len(moved) // CHAIN) * CHAIN)
    back = np.repeat(text.column("back").to_numpy(zero_copy_only=False)[order], per)
    return vocabulary, ids[at][moved], state[moved], back[moved]


class Learner:
    """Weights that are raised step by step along the gradient of chains' likelihood, each by a step as long as its gradients so far were small (AdaGrad)."""

    def __init__(self, k: int, values: np.ndarray, squares: np.ndarray):
        self.k, self.values, self.squares = k, values.copy(), squares.copy()
        self.shapes = [(BUCKETS, k), (k, k), (1 + k * len(CONFIDENCE), k)]

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        """The feature weights, transitions and lexicon weights in a row of numbers."""
        ends = np.cumsum([a * b for a, b in self.shapes])
        return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), self.shapes, strict=True)]

    def learn(self, vocabulary: pa.Array, ids: np.ndarray, states: np.ndarray, lexical: np.ndarray) -> None:
        """One step for each ``CHAINS`` chains; ``lexical`` are the words' features in the lexicon."""
        features, counts = features_of(vocabulary)
        first, size, place = np.cumsum(counts) - counts, CHAIN * CHAINS, np.zeros(len(vocabulary), dtype=np.int64)
        for start in range(0, len(ids), size):
            part = ids[start : start + size]
            words = np.flatnonzero(np.bincount(part, minlength=len(vocabulary)))
            place[words] = np.arange(len(words))
            per = counts[words]
            at = np.repeat(first[words] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            by_chain = (x.reshape(-1, CHAIN).T for x in (place[part], states[start : start + size], lexical[start : start + size]))
            self.step(features.take(at), per, *by_chain)

    def step(self, features: np.ndarray, counts: np.ndarray, row: np.ndarray, states: np.ndarray, lexical: np.ndarray) -> None:
        """One step, for chains as columns: ``row`` of each word in ``counts`` (its features), its state and feature in the lexicon."""
        k, chains = self.k, states.shape[1]
        weights, transitions, lexicon = self.parts(self.values)
        row, lexical = row.ravel(), lexical.ravel()
        scores = sums(weights.take(features, axis=0), counts).take(row, axis=0) + lexicon.take(lexical, axis=0)
        p, expected = expectations(scores.reshape(CHAIN, chains, k), transitions)
        steps = np.bincount((states[:-1] * k + states[1:]).ravel(), minlength=k * k).reshape(k, k)
        # a chain starts from a uniform state that nobody sees
        begin = np.exp(transitions - transitions.max())
        begin /= begin.sum(axis=0)
        gradient = np.empty(len(self.values), dtype=np.float32)
        by_weight, by_transition, by_lexicon = self.parts(gradient)
        for j in range(k):
            wrong = (states == j) - p[:, :, j]
            begin[:, j] *= wrong[0].sum()
            wrong = wrong.ravel()
            by_weight[:, j] = np.bincount(features, np.repeat(np.bincount(row, wrong, len(counts)), counts), BUCKETS)
            by_lexicon[:, j] = np.bincount(lexical, wrong, len(lexicon))
        by_transition[:] = steps - expected + begin
        gradient /= chains
        size = gradient * gradient
        self.squares += size
        np.sqrt(self.squares, out=size)
        size += 1e-6
        gradient *= RATE
        gradient /= size
        self.values += gradient


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word of texts (``lang``, ``text``, ``back``) is used in each language and half; a task adds up about ``TALLIED`` bytes of counts at a time."""
    keys, parts, size = ["word", "lang", "back"], [], 0

    def added_up() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"]).to_batches()

    for batch in batches:
        for one in slices(batch, "text"):
            ids, vocabulary, sizes = split(one.column("text"), NOT_LETTERS)
            langs = one.column("lang").dictionary_encode()
            kinds = 2 * len(langs.dictionary)
            uses = np.bincount(ids.astype(np.int64) * kinds + np.repeat(langs.indices.to_numpy() * 2 + one.column("back").to_numpy(zero_copy_only=False), sizes))
            at = np.flatnonzero(uses)
            parts.append(pa.RecordBatch.from_arrays([vocabulary.take(pa.array(at // kinds)), langs.dictionary.take(pa.array(at % kinds // 2)), pa.array(at % 2 == 1), pa.array(uses[at])], [*keys, "n"]))
            size += parts[-1].nbytes
            if size >= TALLIED:
                yield from added_up()
                parts, size = [], 0
    if parts:
        yield from added_up()


def tally(texts: DataFrame) -> DataFrame:
    """How often each word is used in each language, by halves of the texts: (``word``, ``lang``, ``back``, ``n``), written."""
    found = texts.select("lang", "text", "back").mapInArrow(counted, "word string, lang string, back boolean, n long")
    return cut(found.groupBy("word", "lang", "back").agg(F.sum("n").alias("n")), "words")


def lexicons(counts: DataFrame, langs: list[str]) -> list[np.ndarray]:
    """For each entry the feature that says how surely its words are of their main language: by the uses of one half of the texts, of the other, and of all.

    0 where no language has half of the uses, or there are fewer than three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, "word"):
                at = pc.index_in(one.column("lang"), value_set=pa.array(langs))
                yield pa.RecordBatch.from_arrays([pa.array(entry(one.column("word")).astype(np.int32)), at, one.column("back"), one.column("n")], ["entry", "lang", "back", "n"])

    def feature(n: str) -> Column:
        top, total = F.max(F.struct(n, -F.col("lang"))), F.sum(n)
        sure = sum((top[n] >= c * total).cast("int") for c in CONFIDENCE)
        return F.when((total > 2) & (sure > 0), -top["col2"] * len(CONFIDENCE) + sure).otherwise(0).cast("short").alias(n)

    uses = {"seen": ~F.col("back"), "back": F.col("back"), "all": F.lit(True)}
    by_lang = counts.mapInArrow(run, "entry int, lang int, back boolean, n long").groupBy("entry", "lang").agg(*(F.sum(F.when(which, F.col("n")).otherwise(0)).alias(n) for n, which in uses.items()))
    got = by_lang.groupBy("entry").agg(*(feature(n) for n in uses)).toArrow()
    out = []
    for n in uses:
        lexicon = np.zeros(ENTRIES, dtype=np.int16)
        lexicon[got.column("entry").to_numpy()] = got.column(n).to_numpy()
        out.append(lexicon)
    return out


def fit(texts: DataFrame, counts: DataFrame, langs: list[str], words: int) -> Model:
    """Learn weights and transitions from all ``texts`` (``lang``, ``text``, ``hash``, ``back``), whose ``words`` words are in ``counts``.

    By iterative parameter mixing: texts are dealt to rounds and, in a round, to tasks by their hash; each task
    starts from the weights so far, goes through all its words once (:func:`chained`), and the
    means of the tasks' weights are what the next round starts from. Each half of the texts
    looks words up in the lexicon of the other one, so that its features aren't trusted too much, and predictions
    in that of all. Few words make one round and one task, which goes through them several times.
    """
    spark, k = texts.sparkSession, len(langs)
    seen, back, lexicon = lexicons(counts, langs)
    rounds = 4 if words >= 4 * FEWEST else 1
    share = words / rounds
    tasks = int(max(np.ceil(share / MOST), min(SPREAD, share // FEWEST), 1))
    again = int(np.ceil(STEPS / rounds / max(1, share / tasks / CHAIN / CHAINS)))
    size = (BUCKETS + k + 1 + k * len(CONFIDENCE)) * k
    values, squares = np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)
    both = spark.sparkContext.broadcast((seen, back))

    def task(start: Broadcast, turn: int) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("text", "ascending")])
            learner, random = Learner(k, *start.value), np.random.default_rng([turn, table.column("part")[0].as_py()])
            from_seen, from_back = both.value
            for _ in range(again):
                for batch in table.combine_chunks().to_batches():
                    for one in slices(batch, "text"):
                        vocabulary, ids, states, is_back = chained(one, langs, random)
                        if len(ids):
                            at = entry(vocabulary)[ids]
                            learner.learn(vocabulary, ids, states, np.where(is_back, from_seen[at], from_back[at]))
            found = np.concatenate([learner.values, learner.squares, np.ones(1, dtype=np.float32)])
            return pa.table({"v": pa.array([found], pa.list_(pa.float32()))})

        return run

    for turn in range(rounds):
        start = spark.sparkContext.broadcast((values, squares))
        part = F.pmod(F.shiftright("hash", 2), F.lit(tasks)).cast("int").alias("part")
        dealt = texts.where(F.pmod("hash", F.lit(rounds)) == turn).select("lang", "text", "back", "hash", part).repartition(tasks, "part")
        parts = cut(dealt.groupBy("part").applyInArrow(task(start, turn), "v array<float>"), "weights")
        total = add_up(parts, fan=8)
        drop(parts)
        start.unpersist()
        if total is not None:
            values, squares = (x.astype(np.float32) for x in np.split(total[:-1] / total[-1], 2))
    both.unpersist()
    weights, transitions, lexical = Learner(k, values, squares).parts(values)
    return Model(langs, weights, transitions.astype(float), lexicon, lexical)


def expectations(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals at each word of chains of one length, (word, chain, state), and expected transitions between words."""
    length, chains, k = scores.shape
    step = np.exp(transitions - transitions.max()).astype(float)
    # states above chains: sums over a few states are sums of rows
    emit = np.ascontiguousarray(scores.transpose(0, 2, 1))
    emit = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(float)
    into, forward, back = step.T.copy(), np.empty_like(emit), np.empty_like(emit)
    x = np.full((k, chains), 1 / k)
    for s in range(length):
        x = into @ x
        x *= emit[s]
        x /= x.sum(axis=0)
        forward[s] = x
    y = np.ones((k, chains))
    for s in range(length - 1, -1, -1):
        back[s] = y
        y = step @ (emit[s] * y)
        y /= y.sum(axis=0)
    out = forward * back
    out /= out.sum(axis=1, keepdims=True)
    before, after = (x.transpose(1, 0, 2).reshape(k, -1) for x in (forward[:-1], emit[1:] * back[1:]))
    pairs = (before / ((into @ before) * after).sum(axis=0)) @ after.T * step
    return out.transpose(0, 2, 1), pairs


def held_out(id_col: str) -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All texts with a language that are not held out: ``lang``, ``text``, ``hash``, and whether they are of a random half, ``back``."""
    usable = docs.where(~held_out(id_col) & named(lang_col).isNotNull() & named(text_col).isNotNull())
    lang, text = named(lang_col).cast("string"), named(text_col).cast("string")
    # by id and text, so that neither copies of a text nor rows without an id fall into one part
    found = usable.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.lit(seed), named(id_col), text).alias("hash"))
    return found.withColumn("back", F.getbit("hash", F.lit(40)) == 1)


def learn(docs: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from all documents that are not held out; none if none has words and a language."""
    return learn_both(docs, seed, id_col, text_col, lang_col, familiar=False)[0]


def learn_both(
    docs: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", familiar: bool = True
) -> tuple[Model | None, familiarity.Familiar | None]:
    """What :func:`learn` gives and, if asked for, whether words are of any language learned, from the same documents."""
    texts = labelled(docs, seed, id_col, text_col, lang_col)
    counts = tally(texts)
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return None, None
    found = fit(texts, counts, langs, sum(totals.values())), familiarity.fit_all(texts, counts, langs) if familiar else None
    drop(counts)
    return found


def labels(spark: SparkSession, model: Model | None, familiar: familiarity.Familiar | None = None) -> Callable[[Column], Column]:
    """A function of a text column: its language, score, segments and share of familiar words, as a struct.

    Every word has a probability for each language, by forward-backward over
    the whole text; a text's language (``lang``) has the greatest mean, and that
    mean is the ``score``. Texts that are null or have no letters, and all texts
    where there is no model, are ``und`` with score 0. ``segments`` are runs of
    words with one likeliest language: first word, from 0, number of words, and
    language; empty for texts that are ``und``.

    ``share`` is the share of a text's words that stand in blocks that fit some
    language learned, with or without the words that touch digits, whichever is
    greater; 0 for texts without letters, null without ``familiar``.
    """
    model = spark.sparkContext.broadcast(model) if model is not None else None
    familiar = spark.sparkContext.broadcast(familiar) if familiar is not None else None
    run_type = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])

    def one(text: pa.Array) -> pa.Array:
        own = model.value if model is not None else None
        langs, scores, shares = np.full(len(text), "und", dtype=object), np.zeros(len(text)), np.zeros(len(text))
        ids, vocabulary, counts = split(text, NOT_LETTERS)
        full = np.flatnonzero(counts)
        offsets, flat_runs = np.zeros(len(text) + 1, dtype=np.int32), pa.array([], run_type)
        if own is not None and len(full):
            mean, states = decode(own.emissions(vocabulary), ids, counts[full], own.transitions)
            langs[full] = np.array(own.langs, dtype=object)[mean.argmax(axis=1)]
            scores[full] = np.minimum(1.0, mean.max(axis=1))
            chain = np.repeat(np.arange(len(counts)), counts)
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (states[1:] != states[:-1]) | (chain[1:] != chain[:-1])
            at = np.flatnonzero(new)
            start = at - (np.cumsum(counts) - counts)[chain[at]]
            named_runs = pa.DictionaryArray.from_arrays(pa.array(states[at].astype(np.int32)), pa.array(own.langs, pa.string())).cast(pa.string())
            flat_runs = pa.StructArray.from_arrays([pa.array(start), pa.array(np.diff([*at, len(ids)])), named_runs], fields=list(run_type))
            offsets[1:] = np.cumsum(np.bincount(chain[at], minlength=len(counts)))
        if familiar is not None:
            shares[full] = familiar.value.share(vocabulary, ids, counts[full])
            again = full[shares[full] < 1]
            ids, vocabulary, counts = split(text.take(pa.array(again)), NOT_PLAIN)
            again, counts = again[counts > 0], counts[counts > 0]
            shares[again] = np.maximum(shares[again], familiar.value.share(vocabulary, ids, counts))
        share = pa.array(shares) if familiar is not None else pa.nulls(len(text), pa.float64())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores), pa.ListArray.from_arrays(pa.array(offsets), flat_runs), share], ["lang", "score", "segments", "share"])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.concat_arrays([one(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text")] or [one(text)])

    # so that no rule of the optimizer has it run twice
    return F.arrow_udf(run, "struct<lang: string, score: double, segments: array<struct<word: long, words: long, lang: string>>, share: double>").asNondeterministic()


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each whole text, see :func:`labels`: (id, ``lang_pred``, ``score``, ``segments``)."""
    found = docs.select(named(id_col).alias(id_col), labels(docs.sparkSession, model)(named(text_col).cast("string")).alias("_found"))
    return found.select(named(id_col), F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.segments").alias("segments"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, and predict the language of all.

    Returns ``id_col``, ``held_out``, ``lang_pred``, ``score`` and ``segments``
    (:func:`labels`), a row for each row. The model is fitted on the whole texts of all these documents (:func:`fit`);
    a language is never an input of a prediction. Texts that are null, empty or without letters are ``und``; very
    long ones are gone through in pieces that carry exact messages. Null ids are
    not held out; null languages are not learned; repeated rows and other columns
    don't matter; an empty table gives no rows.
    """
    model = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(named(id_col), "held_out", "lang_pred", "score", "segments")
