"""Spelling variants: a trie of words whose light subtrees are merged with one character skipped or replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.arrowtext import mix, slices
from lakemill.llm.keys import named
from lakemill.llm.storage import cut, drop

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes of the trie whose words don't move to meet them: those with the most words. Any other has fewer than one in as many of the trie's edges.
HOT_NODES = 10_000


def lowered(word: Column) -> Column:
    """With small letters for A to Z, and no others."""
    return F.translate(word, CAPITALS, SMALL)


def runs(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(id, run): each maximal run of letters, lower-cased, that has ``least`` code points or more; null ids are empty."""
    found = F.regexp_extract_all(F.coalesce(named(text_col).cast("string"), F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    return docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run")).select("id", lowered(F.col("run")).alias("run"))


def misspelt(key: Column, run: Column, every: int) -> Column:
    """``run``, without one of its code points where ``every`` divides the checksum of ``key``:``run``."""
    h = F.crc32(F.concat_ws(":", key, run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, least_length: int, least_n: int) -> DataFrame:
    """(word, n) of the only column of ``words``, where both are large enough; counted map-side first."""
    word = named(words.columns[0])
    return words.where(F.length(word) >= least_length).groupBy(word.alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each word down the trie: a row for each node, with the letter that follows there, empty at the word's end.

    A node is a hash of the letters above it. That two nodes share one does no harm: each word only
    needs to see the same heavy letter there as all others.
    """
    for batch in batches:
        for part in slices(batch, "word"):
            texts = part.column("word")
            sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False) + 1
            codes = np.frombuffer("\0".join([*texts.to_pylist(), ""]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
            starts = np.cumsum(sizes) - sizes
            at = np.arange(len(codes)) - np.repeat(starts, sizes)
            powers = np.full(int(sizes.max(initial=1)), 0xD6E8FEB86659FD93, dtype=np.uint64)
            powers[0] = 1
            terms = mix(codes + np.uint64(0x9E3779B97F4A7C15)) * np.multiply.accumulate(powers)[at]
            above = np.cumsum(terms) - terms
            node = mix(above - np.repeat(above[starts], sizes) + at.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            kinds, which = np.unique(codes, return_inverse=True)
            letters = np.array([chr(c) if c else "" for c in kinds.tolist()], dtype=object)
            letter = pa.DictionaryArray.from_arrays(pa.array(which.astype(np.int32)), pa.array(letters, pa.string())).cast(pa.string())
            ends = at == np.repeat(sizes - 1, sizes)
            letter = pc.if_else(pa.array(ends), "", letter)
            wid = np.repeat(part.column("wid").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(wid), pa.array(at.astype(np.int32)), pa.array(node.view(np.int64)), letter], ["wid", "at", "node", "letter"])


def light_edges(words: DataFrame) -> DataFrame:
    """(wid, at, letter, heavy): where the words of ``words`` (wid, word) leave the heavy path of the trie.

    The heavy letter of a node is the one that most of its words go on with; a
    word leaves heavy paths as often as the logarithm of the number of words at most. Edges are counted map-side; the
    nodes with most words, a fixed number, are broadcast, so that no key of the join holds
    more than its share of a ten-thousandth of the edges. ``letter`` is empty where a word ends.
    """
    edges = cut(words.select("wid", "word").mapInArrow(_edges, "wid long, at int, node long, letter string"), "trie")
    kinds = edges.groupBy("node", "letter").agg(F.count("*").alias("n"))
    forks = kinds.groupBy("node").agg(F.max_by("letter", F.struct("n", "letter")).alias("heavy"), F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    forks = cut(forks.select("node", "heavy", "n"), "forks")
    hot = F.broadcast(forks.orderBy(F.desc("n"), "node").limit(HOT_NODES).select("node", "heavy"))
    met = edges.join(hot, "node").unionByName(edges.join(hot.select("node"), "node", "left_anti").join(forks.select("node", "heavy"), "node"))
    light = cut(met.where("letter <> heavy").select("wid", "at", "letter", "heavy"), "light")
    drop(edges)
    drop(forks)
    return light


def near_pairs(words: DataFrame) -> DataFrame:
    """All (word, n, other, other_n) of ``words`` (wid, word, n; words distinct, a written table) that differ by one inserted, deleted or replaced code point, in both directions.

    Two words part at a node of the trie, and one of them, at least, on a
    light edge. So only words below light edges are rewritten, and each few
    times: with the edge's letter replaced by the heavy one, with it skipped,
    and with the heavy one put before it; where that ends at a word, it is a pair. Two light edges of one
    node meet where both are replaced by the same blank, at most as many words as there are letters.
    Of the letters of a run the last is skipped, so that no pair is found twice.
    """
    light = light_edges(words).join(words, "wid").select(
        "word", "n", "letter", "heavy", F.expr("substring(word, 1, at)").alias("above"), F.expr("substring(word, at + 1)").alias("below"), F.expr("substring(word, at + 2)").alias("after")
    )
    goes_on = F.col("letter") != ""
    rewritten = F.array(
        F.when(goes_on, F.concat("above", "heavy", "after")), F.when(goes_on & (F.substring("after", 1, 1) != F.col("letter")), F.concat("above", "after")), F.concat("above", "heavy", "below")
    )
    met = light.select("word", "n", F.explode(rewritten).alias("other")).where("other is not null").join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    one_way, back = F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = met.select(F.explode(F.array(one_way, back)).alias("p")).select("p.*")
    blank = light.where(goes_on).groupBy("above", "after").agg(F.collect_list(F.struct("word", "n")).alias("all")).where(F.size("all") > 1)
    each = blank.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.word <> b.word")
    return pairs.unionByName(each.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form; no circles) from each word ends. Each round doubles the steps taken."""
    held = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut(held.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop(held)
        held = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return held


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Group the spelling variants among ``words`` (``word``, ``n``: distinct words and their counts).

    Two words are near if they differ by one inserted, deleted or replaced code
    point. Returns for each word ``form``, its near word of largest ``n`` (ties: the
    first in code-point order) if that is at least ``ratio`` times its own, else null; ``root``, where forms
    lead to in the end, the word itself if it has none; ``n``, ``n_near`` and ``form_n``.
    Words may be of any length; null words are left out; an empty table gives no rows. Pairs
    are exact, all of them are found, and no group of words is gathered anywhere.
    """
    if ratio <= 1:
        raise ValueError("forms have to be more frequent than what leads to them")
    known = cut(words.where("word is not null").select("word", "n", F.monotonically_increasing_id().alias("wid")), "words")
    near = near_pairs(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("down"), "other")).alias("best"))
    best, size = F.col("best.other"), -F.col("best.down")
    formed = size >= ratio * F.col("n")
    forms = cut(known.drop("wid").join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, best).alias("form"), F.when(formed, size).alias("form_n")), "forms")
    found = roots(forms.where("form is not null"))
    return forms.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, ratio: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words of whole texts that have ``least_length`` code points and come ``least_n`` times, at least.

    Words are maximal runs of Latin letters, lower-cased; by a checksum of the document's id and the word one in
    ``every`` loses a code point, as if misspelt. Null and empty texts have no
    words; very long texts and words are taken whole; repeated rows count each on
    its own; a null id is an empty one; other columns don't matter; an empty table gives no rows.
    """
    found = runs(docs, least_length, id_col, text_col)
    return variants(counted(found.select(misspelt(F.col("id"), F.col("run"), every).alias("word")), least_length, least_n), ratio)
