"""Exact nearest vectors by cosine: groups round pivots, skipped whole where the triangle inequality allows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from agentlake.functions import scoring
from agentlake.operators.retrieval import topk
from agentlake.sources.staging import staged

#: Vectors of a group that a task multiplies at once; pivots whose groups each query begins with; what rounding may do to a bound.
PART, NEAREST, SLACK = 4_096, 2, 1e-6

_HITS = "query_id long, chunk_id long, score double"


def _units(rows: DataFrame, key: str) -> DataFrame:
    """Vectors at unit length, with their number of places; zero vectors are left out."""
    sized = rows.select(key, "user_id", "embedding", F.size("embedding").alias("dim"), scoring.norm(F.col("embedding")).alias("norm")).where("norm > 0")
    return sized.select(key, "user_id", "dim", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("unit"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, 0))


def _nearest(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each vector of a part with its nearest pivot (the lower id of equals) and its distance."""
    cosine = _stack(rows["unit"]) @ _stack(pivots.sort_values("pivot")["center"]).T
    at = cosine.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * cosine[np.arange(len(rows)), at]))
    return pd.DataFrame({"chunk_id": rows["chunk_id"].to_numpy(), "user_id": rows["user_id"].to_numpy(), "dim": rows["dim"].to_numpy(), "unit": rows["unit"].to_numpy(), "pivot": pivots["pivot"].sort_values().to_numpy()[at], "gap": gap})


def pivot_index(vectors: DataFrame, per_pivot: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(members, pivots) of vectors (chunk_id, user_id, embedding): a table to store once and search often.

    Pivots are a user's vectors (of a number of places) of the lowest hash, sqrt(n) * ``per_pivot`` / 2 of them, so vectors and pivots meet
    n^1.5 times when the index is made.  Members have their pivot and are dealt into parts of about ``PART``; pivots have the
    radius of their group and the number of its parts, so a group of very many copies is several tasks.
    """
    own = staged(_units(vectors, "chunk_id"))
    by = ["user_id", "dim"]
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = own.select(*by, "chunk_id", "unit").join(sizes, by)
    share = F.ceil(F.sqrt("n") * (per_pivot / 2)) / F.col("n")
    # About the wanted number; the lowest hash of all is always one.
    chance = (F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    lowest = sizes.join(placed.groupBy(*by).agg(F.min_by("chunk_id", F.struct(chance, "chunk_id")).alias("low")), by).select(*by, F.col("low").alias("chunk_id"))
    chosen = placed.where(chance < share).select(*by, "chunk_id").unionByName(lowest).distinct()
    centers = staged(chosen.join(own.select("chunk_id", *by, "unit"), ["chunk_id", *by]).select(*by, F.col("chunk_id").alias("pivot"), F.col("unit").alias("center")))
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = own.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("chunk_id", F.lit(1)), parts).cast("int")).drop("n")
    copies = centers.join(sizes, by).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    near = dealt.groupBy(*by, "part").cogroup(copies.groupBy(*by, "part")).applyInPandas(_nearest, "chunk_id long, user_id long, dim int, unit array<double>, pivot long, gap double")
    members = staged(near)
    groups = members.groupBy(*by, "pivot").agg(F.max("gap").alias("radius"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    spread = members.join(groups.select(*by, "pivot", "parts"), [*by, "pivot"])
    return spread.select("chunk_id", *by, "unit", "pivot", F.pmod(F.xxhash64("chunk_id", F.lit(2)), F.col("parts")).cast("int").alias("part")), groups.join(centers, [*by, "pivot"])


def _products(asked: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of a part for each query that asks for it."""
    if not len(asked) or not len(rows):
        return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
    score, ids = np.round(_stack(asked["unit"]) @ _stack(rows["unit"]).T, 6) + 0.0, rows["chunk_id"].to_numpy()
    out = []
    for q, line in zip(asked["query_id"], score):
        best = np.lexsort((ids, -line))[:k]
        out.append(pd.DataFrame({"query_id": q, "chunk_id": ids[best], "score": line[best]}))
    return pd.concat(out)


def _scored(wanted: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``wanted``: query_id, user_id, dim, unit, pivot, parts.  Top k of each query over the groups that it wants."""
    keys = ["user_id", "dim", "pivot", "part"]
    asked = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*keys, "query_id", "unit")
    needed = members.join(wanted.select("user_id", "dim", "pivot").distinct(), ["user_id", "dim", "pivot"], "left_semi")
    found = asked.groupBy(*keys).cogroup(needed.groupBy(*keys)).applyInPandas(lambda a, b: _products(a, b, k), _HITS)
    return topk(found, k)


def pivot_topk(queries: DataFrame, vectors: DataFrame, members: DataFrame, pivots: DataFrame, k: int = 10, nearest: int = NEAREST) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_id, score, rank; per query: groups, scored) as ``vector_topk`` gives them, off a pivot index of ``vectors``.

    A vector of a group is no nearer to the query than the pivot is, less the group's radius.  The ``nearest`` groups are
    multiplied out; of the others only those that may hold a cosine as high as the k-th so far.  Vectors of no length, or of
    another number of places, score 0, as do all for a query of no length; they join where fewer than k score above.
    """
    asked = staged(_units(queries, "query_id"))
    toward = asked.join(pivots, ["user_id", "dim"]).withColumn("away", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * scoring.dot(F.col("unit"), F.col("center")))))
    low = F.greatest(F.lit(0.0), F.col("away") - F.col("radius") - SLACK)
    bounds = staged(toward.select("query_id", "user_id", "dim", "unit", "pivot", "parts", "away", (1 - low * low / 2 + SLACK).alias("bound")).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("away", "pivot"))))
    early = staged(_scored(bounds.where(F.col("place") <= nearest), members, k))
    least = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = staged(bounds.where(F.col("place") > nearest).join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(-2.0))))
    late = _scored(more, members, k)
    found = staged(topk(early.unionByName(late).drop("rank"), k))
    # A query whose k-th is not above 0 also has those that score 0 by rule, the smallest ids first.
    full = found.where((F.col("rank") == k) & (F.col("score") > 0)).select("query_id")
    short = queries.select("query_id", "user_id", F.size("embedding").alias("size"), (scoring.norm(F.col("embedding")) > 0).alias("long")).join(full, "query_id", "left_anti")
    flat = vectors.select("user_id", "chunk_id", F.size("embedding").alias("dim"), (scoring.norm(F.col("embedding")) > 0).alias("stands"))
    zero = short.join(flat, "user_id").where(~F.col("long") | ~F.col("stands") | (F.col("size") != F.col("dim")))
    zeros = topk(zero.select("query_id", "chunk_id", F.lit(0.0).alias("score")), k).drop("rank")
    hits = topk(found.drop("rank").unionByName(zeros), k)
    told = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("place") <= nearest).alias("begun"))
    return hits, told.join(more.groupBy("query_id").agg(F.count(F.lit(1)).alias("more")), "query_id", "left").select("query_id", "groups", (F.col("begun") + F.coalesce("more", F.lit(0))).alias("scored"))
