"""From run samples to training sets: reward, duplicates, noise, rejection sampling, exports, pass reports.

Samples have sample_no (input order), task_id, trajectory (events with type, is_error and more), messages, scorer, score,
passed, passed_count, total_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlake.functions import scoring

VOLATILE = ("run_id", "started_at")
VOLATILE_EVENT = ("latency_ms",)
#: Also leaves out what differs between equal runs in practice.
VOLATILE_EVENT_WIDE = ("latency_ms", "ts", "run_id", "cwd")


def with_reward(samples: DataFrame) -> DataFrame:
    r = scoring.reward(*(F.col(c) for c in ("scorer", "score", "passed", "passed_count", "total_count")))
    return samples.withColumns({"reward": r, "source": F.when(F.col("scorer") == "judge", "judge").otherwise("verifiable")})


def content_hash(trajectory: Column, volatile: tuple[str, ...] = VOLATILE, volatile_event: tuple[str, ...] = VOLATILE_EVENT) -> Column:
    """Digest of a trajectory struct without its volatile fields; struct fields keep one order, so equal content gives equal text."""
    events = F.transform(trajectory["events"], lambda e: e.dropFields(*volatile_event))
    return F.sha2(F.to_json(trajectory.dropFields(*volatile).withField("events", events)), 256)


def dedupe_samples(samples: DataFrame, digest: Column) -> DataFrame:
    w = Window.partitionBy("task_id", "digest").orderBy("sample_no")
    return samples.withColumn("digest", digest).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "digest")


def with_tool_counts(samples: DataFrame) -> DataFrame:
    calls = F.filter(F.col("trajectory.events"), lambda e: e["type"] == "ToolCall")
    return samples.withColumns({"tool_calls": F.size(calls), "tool_errors": F.size(F.filter(calls, lambda e: F.coalesce(e["is_error"], F.lit(False))))})


def drop_noise(samples: DataFrame) -> DataFrame:
    """Wrong answers without tool calls, or with failed ones only, teach nothing."""
    return samples.where((F.col("reward") >= 1) | ((F.col("tool_calls") > 0) & (F.col("tool_errors") < F.col("tool_calls"))))


def rejection_sample(samples: DataFrame, top_k: int = 2, cap: int = 4) -> DataFrame:
    """Per task: recoveries (right in spite of tool errors) in input order, then the ``top_k`` best others, all cut at ``cap``."""
    recovered = (F.col("reward") >= 1) & (F.col("tool_errors") > 0)
    inner = Window.partitionBy("task_id", "recovered").orderBy(F.when(F.col("recovered"), 0.0).otherwise(-F.col("reward")), "sample_no")
    chosen = samples.withColumn("recovered", recovered).withColumn("nth", F.row_number().over(inner)).where(F.col("recovered") | (F.col("nth") <= top_k))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("recovered").desc(), "nth"))
    return chosen.withColumn("place", place).where(F.col("place") <= cap).drop("nth")


def export_sft(samples: DataFrame, system_prompt: str) -> DataFrame:
    """Lines of right answers, the system message first."""
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    return samples.where("reward >= 1").select("sample_no", F.to_json(F.struct(F.concat(system, "messages").alias("messages"))).alias("line"))


def export_rlvr(samples: DataFrame) -> DataFrame:
    return samples.where("source = 'verifiable'").select("sample_no", F.to_json(F.struct("task_id", "reward", "passed", "passed_count", "total_count")).alias("line"))


def export_judge(samples: DataFrame) -> DataFrame:
    return samples.where("source = 'judge'").select("sample_no", F.to_json(F.struct("task_id", "reward")).alias("line"))


def build_training_sets(samples: DataFrame, system_prompt: str, top_k: int = 2, cap: int = 4) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What is kept, and its three exports."""
    rewarded = with_tool_counts(with_reward(samples))
    kept = rejection_sample(drop_noise(dedupe_samples(rewarded, content_hash(F.col("trajectory")))), top_k, cap)
    return kept, {"sft": export_sft(kept, system_prompt), "rlvr": export_rlvr(kept), "judge": export_judge(kept)}


def pass_report(tasks: DataFrame) -> DataFrame:
    """Total, passed and rate of all (category null) and of each category."""
    return tasks.cube("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("rate"))


def pass_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda r, n: r.select(F.coalesce("category", F.lit("all")).alias("category"), F.col("rate").alias(n))
    return side(a, "rate_a").join(side(b, "rate_b"), "category", "full").withColumn("delta", F.round(F.col("rate_b") - F.col("rate_a"), 6))
