"""Tables in folders by a hash of their key, so that a change writes the folders of its own keys only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def store(df: DataFrame, root: str, key: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """A new table: one folder per bucket of ``key``."""
    _rows(df, key, buckets).write.partitionBy("bucket").parquet(f"{root}/rows")


def stored(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets; the others' folders are not read."""
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return (rows if only is None else rows.where(F.col("bucket").isin(only))).where("present").drop("bucket", "present")


def _rows(df: DataFrame, key: tuple[str, ...], buckets: int) -> DataFrame:
    return df.withColumns({"bucket": bucket_of(key, buckets), "present": F.lit(True)})


def _known(spark: SparkSession, path: str) -> int | None:
    try:
        row = spark.read.schema("number long").parquet(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None


def change(batch: DataFrame, number: int, root: str, writer: str, key: tuple[str, ...], apply: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Turns the buckets that ``batch`` touches into ``apply(their rows, batch)`` and gives their numbers; the other folders stay as they are.

    The new rows are written beside the table first and noted as whole under the batch's number; only then do they replace the
    folders.  A batch that comes again after a crash (``writer`` and ``number`` name it) is not applied twice: if it was
    noted, its rows replace the folders again, and if not, the table has not been touched.  One writer at a time.
    """
    spark = batch.sparkSession
    beside, note = f"{root}/_beside/{writer}", f"{root}/_note/{writer}"
    # At most ``buckets`` numbers.
    touched = sorted(r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect())
    if not touched:
        return touched
    if _known(spark, note) != number:
        made = _rows(apply(stored(spark, root, touched), batch), key, buckets).where(F.col("bucket").isin(touched))
        # A bucket without rows would keep its old folder: each touched one has a row that is not there for readers.
        empty = spark.createDataFrame([(b, False) for b in touched], "bucket int, present boolean")
        made.unionByName(empty, allowMissingColumns=True).write.mode("overwrite").partitionBy("bucket").parquet(beside)
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(note)
    ready = spark.read.option("basePath", beside).parquet(beside)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/rows")
    return touched
