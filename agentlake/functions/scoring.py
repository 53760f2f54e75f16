"""Arithmetic of scores, costs and rewards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

K1, B = 1.5, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, idf_: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or unequal lengths."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * F.coalesce(price_in, F.lit(0.0)) + tokens_out / 1e6 * F.coalesce(price_out, F.lit(0.0))


def reward(scorer: Column, score: Column, passed: Column, passed_count: Column, total_count: Column) -> Column:
    """The judge's score, or passed tests of all, or 1 and 0; four digits, half to even."""
    part = F.when(passed_count.isNotNull() & (F.coalesce(total_count, F.lit(0)) > 0), passed_count / total_count)
    return F.bround(F.when(scorer == "judge", score).otherwise(F.coalesce(part, F.when(passed, 1.0).otherwise(0.0))), 4)


def lexical_overlap(query_terms: Column, terms: Column) -> Column:
    """Shared terms by query terms, 0 without any."""
    return F.when(F.size(query_terms) > 0, F.size(F.array_intersect(query_terms, terms)) / F.size(query_terms)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
