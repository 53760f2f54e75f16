"""Cutting lineage: results that feed several branches are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, local sessions (tests) get a temporary folder; a cluster has to name one, as each machine would
    write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-staged-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there and
    survives lost executors.  Eager."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/agentlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``staged`` wrote for ``df``, once nothing that is still to be computed reads it."""
    spark, path = df.sparkSession, getattr(df, "staged_at", None)
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: A file above this size has row groups enough to be read by many tasks as it lies.
SMALL_FILE = 128 << 20


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """A table of a single small file, dealt out to the cores: it may be one row group, which one task would read alone.

    Larger files and tables of several files stay as they lie, so at most ``SMALL_FILE`` bytes are shuffled.
    """
    if len(df.inputFiles()) != 1:
        return df
    size = df.select("_metadata.file_size").first()
    return df.repartition(min(most, df.sparkSession.sparkContext.defaultParallelism)) if size and size[0] <= SMALL_FILE else df
