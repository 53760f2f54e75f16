"""What the operators of this package share: Arrow mapping, null-safe document keys, and staging of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agentlake.sources.staging import spread, staged as staged

#: Stands for a null id inside an operator; ids come back as null.
NULL_ID = -(2**63)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID).cast("long"))


def id_back(column: str | Column) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df

