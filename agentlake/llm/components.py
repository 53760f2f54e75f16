"""Connected components: a forest inside one tile in numpy, and star contraction over a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import staged


def local_roots(n: int, i: np.ndarray, j: np.ndarray, roots: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes over the links (i, j), going on from ``roots``."""
    roots = np.arange(n) if roots is None else roots.copy()
    while True:
        a, b = roots[i], roots[j]
        if (a == b).all():
            return roots
        low = np.minimum(a, b)
        np.minimum.at(roots, a, low)
        np.minimum.at(roots, b, low)
        while (roots[roots] != roots).any():
            roots = roots[roots]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star steps: first every node hands its larger neighbours to its
    smallest one, then its smaller ones.  Minima are summed up before the shuffle and the joins are plain
    equi-joins, so a node of very many links can be split.  Each round is written to the shared folder.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
