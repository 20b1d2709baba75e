"""Connected components of a graph given as edges, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.storage import cut, drop, shuffled


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, src: str, dst: str, node: str = "node", component: str = "component") -> DataFrame:
    """For each node of an edge, the smallest node that edges lead to.

    Large-star and small-star contraction: each round points the neighbours of
    a node at the smallest of them, until every component is a star. Rounds
    grow with the logarithm of the diameter. A node's smallest neighbour is a
    map-side combined minimum, and each round is a written table, so a hot node
    is neither collected nor recomputed. Self-loops keep their node; nulls are
    left out; no edges give no rows. Nodes may be of any type with an order.
    """
    a, b = F.greatest(src, dst), F.least(src, dst)
    stars = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(a.alias("a"), b.alias("b")).distinct(), "edges")
    state = _state(stars)
    while state[0]:
        # small star: a node points its smaller neighbours, and itself, at the smallest
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(shuffled(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        small = small.where("a > b").distinct()
        # large star: a node points its larger neighbours at the smallest of all
        both = small.unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        loops = stars.where("a = b")
        after = cut(large.unionByName(loops), "edges")
        new = _state(after)
        drop(stars)
        stars = after
        if new == state:
            break
        state = new
    tops = stars.select(F.col("b").alias(node), F.col("b").alias(component))
    return stars.select(F.col("a").alias(node), F.col("b").alias(component)).unionByName(tops).groupBy(node).agg(F.min(component).alias(component))
