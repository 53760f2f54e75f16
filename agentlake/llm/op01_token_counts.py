"""Token counts: an exact histogram of encoded lengths, and what follows from it for every context limit.

Every document is encoded whole, once.  Equal lengths are added up before the shuffle, so what is
shuffled and kept is one row per distinct length, not per document.  Suffix sums over that histogram
answer, for a limit L: documents longer than L, tokens in them, tokens left if every document is cut at
L, and the share of documents that fit.  They are taken in two steps, over blocks of lengths and inside
each block, so no task holds the whole histogram.  The histogram is written once, as two steps read it.

Defined results: a null text counts as empty (0 tokens); repeated rows count each; an empty table gives
an empty histogram; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import map_batches, staged, table, texts
from .tokens import DEFAULT_VOCABULARY, encoder, vocabulary_path

#: Lengths in one block of the two-step suffix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each row."""
    path = vocabulary_path(vocabulary)

    def lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        n = pa.array([enc.count(t) for t in texts(batch, text)], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n], [*keep, "n_tokens"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs.select(*keep, text), lengths, f"{kinds}n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """One row per occurring length, read as a context limit.

    n_tokens, n_docs (of just that length), docs_over (longer), tokens_over (theirs, uncut), tokens_cut
    (of all documents, each cut at the limit), tokens_all, share_fitting (documents not longer).
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    total = Window.partitionBy()
    blocks = (
        h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(later), zero).alias("docs_later"),
            F.coalesce(F.sum("t").over(later), zero).alias("tokens_later"),
            F.sum("d").over(total).alias("docs_all"),
            F.sum("t").over(total).alias("tokens_all"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda part, rest: F.coalesce(F.sum(part).over(inside), zero) + F.col(rest)
    return (
        h.join(blocks, "block")
        .withColumn("docs_over", over("n_docs", "docs_later"))
        .withColumn("tokens_over", over("tokens", "tokens_later"))
        .select(
            "n_tokens", "n_docs", "docs_over", "tokens_over",
            (F.col("tokens_all") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_cut"),
            "tokens_all",
            (1 - F.col("docs_over") / F.col("docs_all")).alias("share_fitting"),
        )
    )


def length_quantiles(totals: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The smallest limit that at least such a share of documents fits."""
    return totals.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "n_tokens", "share_fitting").where("share_fitting >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(staged(length_histogram(token_lengths(table(spark, sf_dir, "documents")))))


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
