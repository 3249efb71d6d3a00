"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def stars(edges: DataFrame, label: str = "stars") -> DataFrame:
    """``(node, root)`` for every node that is not the smallest of its component, from
    undirected edges ``(a, b)``.

    Alternates two steps until the edges stay the same: every node links its larger
    neighbours to its smallest one, then its smaller neighbours and itself to the
    smallest.  Each step is an aggregate and a join on edges alone, and each round is
    written, so a lost executor costs one round.  Self links and repeated or null edges
    are dropped."""
    links = materialize(edges.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.union(low.select("u", "m")).distinct(), label)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def forest(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest reachable place of every place, after links between ``x`` and ``y`` are
    added to ``root``, which points every place to its smallest one so far."""
    while len(x):
        x, y = root[x], root[y]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        np.minimum.at(root, y, x)
        while not np.array_equal(root, up := root[root]):
            root = up
    return root
