"""Run logs as event rows: totals, budgets, streaks, timelines, messages, ledgers, contexts.

Events have run_id, pos, type, ts and the fields of their type; messages have session_id, idx, role, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlake.functions.text import canonical_json


def run_totals(events: DataFrame) -> DataFrame:
    """Tokens, turns and cache hit rate of each run, from its model calls."""
    call = lambda c: F.sum(F.when(F.col("type") == "LlmCall", F.col(c)))
    hit, miss = call("cache_hit"), call("cache_miss")
    return events.groupBy("run_id").agg(
        F.coalesce(call("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(call("output_tokens"), F.lit(0)).alias("output_tokens"), F.count_if(F.col("type") == "LlmCall").alias("turns"),
        F.round(F.coalesce(hit / F.nullif(hit + miss, F.lit(0)), F.lit(0.0)), 6).alias("cache_hit_rate"),
    )


def budget_cut(events: DataFrame, ceiling: float) -> DataFrame:
    """The first turn of each run at which its cost so far exceeds the ceiling."""
    w = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spent = events.withColumn("spent", F.round(F.sum("cost").over(w), 6)).where(F.col("spent") > ceiling)
    return spent.groupBy("run_id").agg(F.min_by("pos", "pos").alias("pos"), F.min_by("spent", "pos").alias("spent"))


def denial_streaks(events: DataFrame, n: int = 5) -> DataFrame:
    """Runs of denied calls: run_id, first and last place, length, alert from ``n`` on."""
    order = Window.partitionBy("run_id").orderBy("pos")
    own = Window.partitionBy("run_id", "denied").orderBy("pos")
    islands = events.withColumn("at", F.row_number().over(order)).withColumn("island", F.col("at") - F.row_number().over(own)).where("denied")
    runs = islands.groupBy("run_id", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("length"))
    return runs.drop("island").withColumn("alert", F.col("length") >= n)


def timeline(events: DataFrame, mode: str) -> DataFrame:
    """start and width of each event: by sequence, by summed duration (1 ms at least), or on the clock from the run's first event."""
    w = Window.partitionBy("run_id").orderBy("pos")
    width = F.greatest(F.coalesce("latency_ms", F.lit(0)), F.lit(1)).cast("double")
    start = {
        "sequence": (F.row_number().over(w) - 1).cast("double"),
        "duration": F.coalesce(F.sum(width).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "clock": (F.unix_micros("ts") - F.first(F.unix_micros("ts")).over(w)) / 1000,
    }[mode]
    return events.select("run_id", "pos", start.alias("start"), (F.lit(1.0) if mode == "sequence" else width).alias("width"))


def to_messages(events: DataFrame) -> DataFrame:
    """One row per run: its chat messages in order, as an array of structs."""
    role = F.when(F.col("type") == "RunStarted", "user").when(F.col("type") == "LlmCall", "assistant").when(F.col("type") == "ToolCall", "tool")
    rows = events.withColumn("role", role).where("role is not null")
    message = F.struct("pos", "role", F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("role") == "tool", F.col("call_id")).alias("tool_call_id"))
    return rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: m.dropFields("pos")).alias("messages"))


def pair_tool_calls(events: DataFrame) -> DataFrame:
    """Each tool result with the model call that asked for it by call id; matched tells whether there is one."""
    asked = events.where("type = 'LlmCall'").select("run_id", F.col("pos").alias("asked_at"), F.explode("call_ids").alias("call_id"))
    return events.where("type = 'ToolCall'").select("run_id", "pos", "call_id").join(asked, ["run_id", "call_id"], "left").withColumn("matched", F.col("asked_at").isNotNull())


def call_key(name: Column, arguments: Column) -> Column:
    """Name and canonical arguments: keys sorted at every depth, types kept, so calls share a key if and only if they ask for the same.

    No arguments are an empty object; what isn't a JSON object stays as it is, and never equals one.
    """
    given = F.coalesce(F.nullif(arguments, F.lit("")), F.lit("{}"))
    parsed = canonical_json(given)
    return F.concat(name, F.when(F.startswith(parsed, F.lit("{")), F.concat(F.lit(":"), parsed)).otherwise(F.concat(F.lit("?"), given)))


def tool_ledger(events: DataFrame) -> DataFrame:
    """The last completed result of each canonical call in a run; denied, unknown and crashed calls don't count."""
    done = events.where("type = 'ToolCall' and not denied and not unknown and not crashed").withColumn("key", call_key(F.col("name"), F.col("arguments")))
    w = Window.partitionBy("run_id", "key").orderBy(F.col("pos").desc())
    return done.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("run_id", "key", "pos", "result")


def session_timeline(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Events of a session's runs, oldest run first, numbered on, with the first run's model."""
    w = Window.partitionBy("session_id").orderBy("created_at", "run_id")
    placed = runs.withColumns({"nth": F.row_number().over(w), "session_model": F.first("model").over(w)})
    joined = events.join(placed.select("run_id", "session_id", "nth", "session_model"), "run_id")
    return joined.withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy("nth", "pos")) - 1).select("session_id", "at", "run_id", "pos", "session_model")


def compaction_cut(messages: DataFrame, keep: int = 8, result_role: str = "tool") -> DataFrame:
    """Where the kept tail begins: the last ``keep`` messages, moved back to a message that is no tool result."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    placed = messages.withColumn("at", F.row_number().over(Window.partitionBy("session_id").orderBy("idx")) - 1).withColumn("from", F.greatest(n - keep, F.lit(0)))
    cut = F.max(F.when((F.col("at") <= F.col("from")) & (F.col("role") != result_role), F.col("at")))
    return placed.groupBy("session_id").agg(F.coalesce(cut, F.lit(0)).cast("long").alias("cut"), F.count(F.lit(1)).alias("n"))


def session_context(messages: DataFrame, compactions: DataFrame) -> DataFrame:
    """The latest summary of a session, as row -1, and the messages behind what it covers."""
    w = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("covered_upto_idx").desc())
    latest = compactions.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("session_id", "covered_upto_idx", "summary")
    rest = messages.join(latest, "session_id", "left").where(F.col("idx") > F.coalesce("covered_upto_idx", F.lit(-1))).select("session_id", "idx", "role", "text")
    return rest.unionByName(latest.select("session_id", F.lit(-1).cast("long").alias("idx"), F.lit("summary").alias("role"), F.col("summary").alias("text")))
