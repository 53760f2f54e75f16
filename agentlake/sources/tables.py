"""Readers and writers: chunk tables, run logs, audit days, golden sets, task sets, listings, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from agentlake.operators.evaluation import validate_golden
from agentlake.operators.numbering import numbered

CHUNK_BUCKETS = 64

EVENT = "type string, ts double, run_id string, session_id string, user_id string, model string, cwd string, tools array<string>, prompt string, turn int, input_tokens long, output_tokens long, stop_reason string, latency_ms long, text string, tool_calls array<struct<id:string,name:string,arguments:string>>, cache_hit_tokens long, cache_miss_tokens long, call_id string, name string, arguments string, result string, is_error boolean, denied boolean, dropped int, chars_before int, chars_after int, message string, turns int"
TRAJECTORY = f"run_id string, started_at double, events array<struct<{', '.join(':'.join(f.strip().split(' ', 1)) for f in EVENT.split(', '))}>>"
GOLDEN = "id string, query string, user_id long, gold_chunk_keys array<string>, category string, tags array<string>, ground_truth string, notes string, answer_excerpts array<string>"
TASK = "id string, prompt string, category string, tags array<string>, scorer string"


def write_chunks(chunks: DataFrame, path: str) -> None:
    """By bucket of the user, so that a user's read opens one folder."""
    chunks.withColumn("bucket", F.col("user_id") % CHUNK_BUCKETS).write.partitionBy("bucket").mode("append").parquet(path)


def read_chunks(spark: SparkSession, path: str, users: list[int] | None = None) -> DataFrame:
    chunks = spark.read.parquet(path)
    return chunks if users is None else chunks.where(F.col("bucket").isin([u % CHUNK_BUCKETS for u in users]) & F.col("user_id").isin(users))


def read_trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, lines that are no run) of JSON lines."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("run", F.from_json("value", f"{TRAJECTORY}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    good = F.col("run").isNotNull() & F.col("run._broken").isNull() & F.col("run.run_id").isNotNull()
    return lines.where(good).select("run.*").drop("_broken"), lines.where(~good).select("value")


def run_events(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("run_id").alias("run"), F.posexplode("events").alias("pos", "event")).select(F.col("run").alias("run_id"), "pos", *(F.col(f"event.{f.split(' ')[0]}").alias(f.split(" ")[0]) for f in EVENT.split(", ") if not f.startswith("run_id")))


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.date_format(F.col(ts), "yyyy-MM-dd"))


def write_trajectories(runs: DataFrame, path: str) -> None:
    """One run a line, in the folder of its day."""
    _by_day(runs.withColumn("at", F.timestamp_seconds("started_at")), "at").drop("at").write.partitionBy("day").mode("append").json(path)


def write_audit(events: DataFrame, path: str, ts: str = "ts") -> None:
    _by_day(events, ts).write.partitionBy("day").mode("append").parquet(path)


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, rejected with their reason) of a JSON file with a ``cases`` array."""
    raw = spark.read.schema(f"cases array<struct<{', '.join(':'.join(f.strip().split(' ', 1)) for f in GOLDEN.split(', '))}>>").json(path, multiLine=True)
    told = validate_golden(raw.select(F.explode("cases").alias("c")).select("c.*").withColumnsRenamed({"id": "case_id", "gold_chunk_keys": "keys"}))
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task files of a folder and those below, numbered in the order of their paths."""
    tasks = spark.read.schema(TASK).option("recursiveFileLookup", "true").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    return numbered(tasks, ["file", "id"], name="at")


SUPPORTED = ("txt", "md", "html", "htm", "csv", "tsv")


def list_inputs(spark: SparkSession, path: str, supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """path, length, supported of every file below; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.withColumn("supported", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*supported))


def publish(df: DataFrame, root: str, name: str | None = None) -> str:
    """A new version of a table in a folder of its own; the pointer names it once it is written whole.

    With ``name``, as a stream's batch has one, writing it again replaces what an attempt that failed has left, and a name that
    the pointer has already is not published twice.
    """
    spark, version = df.sparkSession, name or uuid.uuid4().hex
    known = _pointer(spark, root)
    last = known.agg(F.max("number"), F.max(F.col("version") == version)).first() if known is not None else None
    if last and last[1]:
        return version
    df.write.mode("overwrite" if name else "error").parquet(f"{root}/versions/{version}")
    number = (last[0] if last and last[0] is not None else 0) + 1
    spark.createDataFrame([(version, number)], "version string, number long").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def _pointer(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema("version string, number long").parquet(f"{root}/pointer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names last."""
    version = _pointer(spark, root).agg(F.max_by("version", "number")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}")


def write_exports(exports: dict[str, DataFrame], root: str) -> None:
    """The lines of each training set as text files in a folder of its name, ready as JSON lines."""
    for name, rows in exports.items():
        rows.select("line").write.mode("overwrite").text(f"{root}/{name}")
