"""Row numbers over a whole table, or over very large groups of it, without sorting either in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlake.sources.staging import staged

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str | Column], within: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """``df`` with ``name``, from 0 in the order of ``order`` inside equal values of ``within`` (nulls are equal, and come first).

    Two passes: rows are dealt out to ranges of (within, order) and sorted there, so a row's place in its partition is known;
    then the rows of each (within, partition) are counted and the counts added up, one row per pair.  A group of any
    size is spread over many ranges.  Rows that tie in ``order`` get their numbers in no particular order, but stay together as they
    are written, as the sorted ranges are staged.  An empty table gives an empty one.
    """
    keys = [F.col(c) for c in within] + [F.col(c) if isinstance(c, str) else c for c in order]
    placed = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", _PLACE_BITS))
    pairs = placed.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pairs.select(*(F.col(c).alias(f"_w{k}") for k, c in enumerate(within)), F.col("_part").alias("_p"), (before - F.col("_low")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for k, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_w{k}"))
    return placed.join(offsets, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))
