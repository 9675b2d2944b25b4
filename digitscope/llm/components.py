"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from digitscope.llm.shared import stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every linked node but the roots; the root is the smallest node of its component.

    Each round moves every node's larger neighbours, then its smaller ones, to the smallest node known
    nearby; the number of links never grows, and rounds grow with the logarithm of the longest chain. Minima
    are combined before the shuffle. Every round is a written table, so the sides of the joins are plain
    shuffles in which adaptive execution can split a node with very many links. Nulls and links of a node
    to itself are left out; an empty input gives an empty result.
    """
    pairs = stored(links.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi"))
                   .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct())
    seen = None
    while True:
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())
        if now == seen or now[0] == 0:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now
        both = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("next")).union(pairs.select("lo", "hi"))
        least = stored(both.groupBy("node").agg(F.min("next").alias("root")).select("node", F.least("node", "root").alias("root")))
        large = stored(both.join(least, "node").where("next > node").select(F.col("root").alias("lo"), F.col("next").alias("hi"))
                       .distinct())
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("root")))
        small = large.join(least, "hi").where("lo > root").select(F.col("root").alias("lo"), F.col("lo").alias("hi"))
        pairs = stored(small.union(least.select(F.col("root").alias("lo"), "hi")).distinct())


def join_labels(labels, left, right):
    """Join the sets that linked items stand in: ``labels[i]`` is the smallest item of i's set (numpy arrays)."""
    import numpy as np

    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        if not apart.any():
            return
        left, right = left[apart], right[apart]
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further
