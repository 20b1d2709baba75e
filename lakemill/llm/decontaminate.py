"""Benchmark decontamination: size-partitioned MinHash containment search, natively."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemill.llm.keys import bit_map, bit_words, marked, named, row_key, variable
from lakemill.llm.storage import cut

#: What stands between two words, for SQL's and the operator's text alike.
NOT_WORD = r"[^\p{L}\p{N}]+"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once for each row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array if there are none."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), lambda w: w != "")


def windows(words: Column, width: int, join) -> Column:
    """``join`` of each run of ``width`` words, without repeats; of all words if there are fewer.

    No words, no windows. ``words`` has to be a column or a bound variable.
    """
    n = F.size(words)
    whole = F.transform(F.sequence(F.lit(0), n - width), lambda i: join([F.get(words, i + k) for k in range(width)]))
    short = F.array(join([F.coalesce(F.get(words, F.lit(k)), F.lit("")) for k in range(width)]))
    return F.array_distinct(F.when(n >= width, whole).when(n > 0, short))


def shingle_hashes(text: Column, width: int) -> Column:
    """64-bit hashes of a text's shingles."""
    return bound(words_of(text), lambda w: windows(w, width, lambda ws: F.xxhash64(*ws)))


def shingles(text: Column, width: int) -> Column:
    """A text's shingles as strings, for comparisons that have to be exact."""
    return bound(words_of(text), lambda w: windows(w, width, lambda ws: F.concat_ws(" ", *ws)))


def sketch_size(least: int, threshold: float, miss: float) -> int:
    """Hash functions with which an item of ``least`` to ``2 * least - 1`` shingles, contained at ``threshold``, is missed with probability ``miss``.

    Of such items' shingles a share of ``1 - threshold`` may be missing, less where shingles are few.
    """
    missing = max((n - math.ceil(threshold * n - 1e-9)) / n for n in range(least, min(2 * least, least + 1000)))
    return 1 if missing <= 0 else max(1, math.ceil(math.log(miss) / math.log(missing)))


def least_under(sh: str, seed: int) -> Column:
    """The shingle hash in ``sh`` that is least under one seeded hash function."""
    # a lambda with a second argument would be given the index there
    return F.array_min(F.transform(sh, lambda s: F.struct(F.xxhash64(F.lit(seed), s).alias("v"), s.alias("s")))).s


def sketch_of(sh: str, hashes: int) -> Column:
    """The shingle hashes in ``sh`` that are least under ``hashes`` seeded hash functions, without repeats."""
    return F.array_distinct(F.array(*(least_under(sh, seed) for seed in range(hashes))))


#: Bits of the map of sketched shingles for each of them: one other shingle in 10,000 passes by mistake while the map isn't full.
BITS_PER_KEY = 256


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold`` of the shingles.

    Short items in long documents have a tiny Jaccard similarity, so MinHash is
    asymmetric here: an item's sketch is its least shingle under each of a few
    seeded hash functions, each document is searched for them whole, and an item
    contained at the threshold is missed with probability ``miss``. Items are
    partitioned by size, in powers of two; a partition has its own number of hash
    functions and its own index of sketched shingles, and a document looks
    things up in the partitions alone whose smallest items it could hold at the threshold.
    Candidates are verified by exact containment of word shingles.

    Documents are read twice, however many items there are. The first time they are cut into
    shingles, which are tested against a bit map of all sketched ones, of a size that is bounded; what
    passes, by mistake or not, goes on as hashes alone, and those meet the partitions' index in a join. Of documents that hold a sketched
    shingle of a partition of theirs, for certain, texts are fetched the second time, one of equal
    rows, and meet their candidates. Nothing of other documents is shuffled but such hashes. Joins are broadcast only where Spark finds a side small enough.

    Returns ``id_col``, ``item_col``, ``matched`` and ``item_shingles`` (long)
    and ``containment`` (double), one row for each
    document and item. Texts of fewer than ``width`` words have one shingle of
    all words (so shorter items are found only in documents of just those words), null and texts without words none: they match nothing. Repeated
    rows give repeated results, null ids are kept, other columns are ignored, whatever their names;
    an empty table on either side gives no rows.
    """
    text = named(item_text_col).cast("string")
    exact = items.select(F.monotonically_increasing_id().alias("row"), named(item_col).alias("item"), shingles(text, width).alias("item_sh"), shingle_hashes(text, width).alias("sh")).where(F.size("sh") > 0)
    exact = cut(exact.withColumn("part", F.floor(F.log2(F.size("sh"))).cast("int")), "items")
    parts = sorted(r.part for r in exact.select("part").distinct().collect()) or [0]
    sketch = functools.reduce(lambda s, c: s.when(F.col("part") == c, sketch_of("sh", sketch_size(1 << c, threshold, miss))), parts, F.when(F.lit(False), F.col("sh")))
    index = cut(exact.select("row", "part", sketch.alias("sk")).select("row", "part", "sk", F.explode("sk").alias("h")), "index")
    keys = index.select("h").distinct()
    words, bits = bit_words(keys, keys.count(), BITS_PER_KEY)
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")).withColumn("doc", row_key(F.col("id"), F.col("text")))
    with variable(words) as known:
        # what of a document's shingles is sketched of some item
        held = bound(shingle_hashes(F.col("text"), width), lambda sh: F.struct(F.size(sh).alias("x"), F.filter(sh, lambda s: marked((known, bits), s)).alias("hits")))
        near = cut(rows.select("doc", "id", held.alias("held")).where(F.size("held.hits") > 0), "near")
    # the last partition that a document could hold an item of
    last = F.floor(F.log2(F.col("held.x") / threshold + 1e-9)).cast("int")
    kinds = near.groupBy("doc").agg(F.first("held").alias("held"))
    asked = kinds.select("doc", F.col("held.hits").alias("hits"), F.filter(F.array(*(F.lit(c) for c in parts)), lambda c: c <= last).alias("parts"))
    asked = asked.select("doc", "hits", "parts", F.explode("hits").alias("h")).select("doc", "hits", "h", F.explode("parts").alias("part"))
    # a pair that meets on several sketched shingles counts where it meets first
    met = cut(asked.join(index, ["part", "h"]).where(F.get(F.array_intersect("sk", "hits"), F.lit(0)) == F.col("h")).select("doc", "row"), "met")
    wanted = met.select(F.xxhash64("doc").alias("h")).distinct()
    texts = rows.where(marked(bit_map(wanted, wanted.count()), F.xxhash64("doc"))).groupBy("doc").agg(F.first("text").alias("text"))
    pairs = met.join(texts, "doc").join(exact.select("row", "item", "item_sh"), "row")
    matched = F.size(F.array_intersect("item_sh", shingles(F.col("text"), width)))
    sizes = pairs.select("doc", "item", matched.cast("long").alias("matched"), F.size("item_sh").cast("long").alias("item_shingles"))
    counted = sizes.where(F.col("matched") >= F.col("item_shingles") * threshold - 1e-9).join(near.select("doc", "id"), "doc")
    share = F.col("matched") / F.col("item_shingles")
    return counted.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", "item_shingles", share.alias("containment"))
