"""Streams over the tables, each in several micro-batches and restarts, with the SQL of its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from agentlake.operators import retrieval
from agentlake.plans.governance import SQL as BATCH
from agentlake.plans.relations import ACTIVITY, CORPUS, LINES, corpus, line_chunks, table
from agentlake.plans.retrieval import OUTCOMES, PLANNED, TOKENS, searched
from agentlake.plans.runs import memories, written
from agentlake.sources import buckets
from agentlake.sources.staging import staging_root
from agentlake.streaming import jobs

#: Every stream gets its rows in so many parts, one after the other, and starts anew from its checkpoint with each.
PARTS = 3


def _root(spark) -> str:
    return f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"


def _fed(rows: DataFrame, order: str, start: Callable[[DataFrame], StreamingQuery], root: str) -> None:
    """Runs ``start`` on what has come so far, after each of ``PARTS`` equal ranges of ``order``."""
    spark = rows.sparkSession
    at = F.expr(order)
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - F.lit(low)) * PARTS / F.lit((high or 0) - (low or 0) + 1)), F.lit(PARTS - 1))
    # A stateful stream keeps its number of partitions, each with a store and a worker of its own: a few for each core do.
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        for k in range(PARTS):
            rows.where(part == k).write.mode("append").parquet(f"{root}/in")
            start(spark.readStream.schema(rows.schema).parquet(f"{root}/in")).awaitTermination()
    finally:
        spark.conf.set(name, before)


def _finished(rows: DataFrame, order: str, job: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What the job has given once all parts of ``rows`` have gone by."""
    spark, root = rows.sparkSession, _root(rows.sparkSession)
    # A batch that comes again replaces its own folder; a complete result replaces all.
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/rows/batch={0 if mode == 'complete' else number}")
    shape = job(spark.readStream.schema(rows.schema).parquet(f"{root}/in*")).schema
    _fed(rows, order, lambda stream: job(stream).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(), root)
    return spark.read.schema(shape).parquet(f"{root}/rows").select(*(f.name for f in shape))


def _events(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("month", F.date_format("ts", "yyyy-MM"))


BY_TIME = "unix_micros(ts)"


def stream_counts(spark, d):
    out = _finished(_events(spark, d), BY_TIME, lambda s: jobs.windowed_counts(s, ("event_type",), "1 day", value="value"), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_histogram(spark, d):
    out = _finished(_events(spark, d), BY_TIME, lambda s: jobs.windowed_histogram(s, "value", (1.0, 10.0, 50.0), ("event_type",), "7 days"), "complete")
    return out.groupBy("event_type", "at").agg(F.sum("n").alias("n")).withColumnRenamed("at", "bucket")


def stream_rate_windows(spark, d):
    return _finished(_events(spark, d), BY_TIME, lambda s: jobs.rate_limited(s, 86_400.0, 3))


def stream_quota(spark, d):
    usage = _events(spark, d).where("event_type = 'purchase'").withColumns({"input_tokens": F.floor("value"), "output_tokens": F.floor(F.col("value") / 2)})
    return _finished(usage, BY_TIME, lambda s: jobs.running_quota(s, 500))


def stream_denials(spark, d):
    """The third error or view in a row of each user."""
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").isin("error", "view").alias("denied"))
    return _finished(calls, "pos", lambda s: jobs.denial_alerts(s, 3))


def stream_stale(spark, d):
    """Each user's events as changes of a document: views leave it pending, all else settles it; half a day without a word is too long."""
    changes = _events(spark, d).select(F.col("user_id").cast("string").alias("doc_key"), F.when(F.col("event_type") == "view", "pending").otherwise("ready").alias("status"), "ts")
    out = _finished(changes, BY_TIME, lambda s: jobs.stale_pending(s, 43_200, "1 hour"))
    return out.select("doc_key", F.unix_micros("since").alias("since"), "status")


def stream_reasoning(spark, d):
    """Conversations as pieces whose ends cut tags in two: even turns open a span, odd ones go on with the tag and close it."""
    t, ended = F.coalesce("text", F.lit("")), Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    piece = F.when(F.col("turn") % 2 == 0, F.concat(t, F.lit("<thi"))).otherwise(F.concat(F.lit("nk>"), F.substring(t, 1, 40), F.lit("</think>"), F.substr(t, F.lit(41), F.length(t))))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").cast("long").alias("seq"), piece.alias("text"), (F.row_number().over(ended) == 1).alias("last"))
    out = _finished(rows, "seq", jobs.reasoning_deltas)
    told = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), ""))
    return out.groupBy("stream").agg(told("visible").alias("visible"), told("thinking").alias("thinking"))


def stream_ingest(spark, d):
    """Every other document changes three times, a third of them new to the store; the last change's chunks are what is there at the end."""
    rows = line_chunks(spark, d).select("doc_key", "doc_id", "seq", F.lit(1).alias("version"), "text")
    changed = rows.where("doc_id % 2 = 0").withColumn("version", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).withColumn("text", F.concat_ws("-", "text", "version")).where("version < 4 or seq % 2 = 0")
    root = _root(spark)
    buckets.store(rows.where("doc_id % 6 <> 0").drop("doc_id"), root, ("doc_key",))
    _fed(changed.drop("doc_id"), "version", lambda s: jobs.ingest_stream(s, root, f"{root}/checkpoint"), root)
    return buckets.stored(spark, root).select("doc_key", "seq", "version", F.md5("text").alias("digest"))


def stream_memories(spark, d):
    """Later turns are written as a stream to a state of the first two."""
    rows, root = memories(spark, d), _root(spark)
    buckets.store(rows.where("id % 1000 < 2").withColumn("superseded_by", F.lit(None).cast("long")), root, ("user_id",))
    _fed(rows.where("id % 1000 >= 2"), "id", lambda s: jobs.memory_stream(s, root, f"{root}/checkpoint", 100), root)
    return buckets.stored(spark, root).select("id", "user_id")


def stream_index(spark, d):
    """The stored lexical index of two thirds of the documents, after each fourth changed in one of three rounds or came new."""
    chunks, root = corpus(spark, d), _root(spark)
    buckets.store(retrieval.lexical_index(chunks.where("chunk_id % 3 <> 0")), root, ("doc_key",))
    turn = F.col("chunk_id") % 4
    changed = chunks.where(turn > 0).withColumn("text", F.concat(F.lit("renewed_"), turn.cast("string"), F.lit(" "), "text"))
    _fed(changed, "chunk_id % 4", lambda s: jobs.index_stream(s, root, f"{root}/checkpoint", None), root)
    return buckets.stored(spark, root).select("user_id", "doc_key", "term", "tf", "dl")


def stream_outcomes(spark, d):
    """How searches with failing channels ended, by the hour: a search a minute in the order of the queries."""
    told = searched(spark, d)[1].withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("query_id") * 60))
    out = _finished(told, BY_TIME, lambda s: jobs.windowed_counts(s, ("mode", "outcome", "degraded"), "1 hour", value="served"), "complete")
    return out.select(F.unix_timestamp("start").alias("start"), "mode", "outcome", "degraded", "n", "total")


def stream_audit(spark, d):
    """Events in the folders of their days, read back."""
    root = _root(spark)
    _fed(_events(spark, d), BY_TIME, lambda s: jobs.append_by_day(s, f"{root}/audit", f"{root}/checkpoint"), root)
    stored = spark.read.parquet(f"{root}/audit")
    return stored.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_counts, stream_histogram, stream_rate_windows, stream_quota, stream_denials, stream_stale, stream_reasoning, stream_ingest, stream_memories, stream_index, stream_outcomes, stream_audit)}
PIECES = "pieces as (select conv_id as stream, string_agg(case when turn % 2 = 0 then t || '<thi' else 'nk>' || substr(t, 1, 40) || '</think>' || substr(t, 41) end, '' order by turn) as t from (select conv_id, turn, coalesce(text, '') as t from conversations) group by 1)"
SQL = {
    "stream_denials": "with c as (select user_id::varchar as run_id, event_id as pos, event_type in ('error', 'view') as denied, count(*) filter (where event_type not in ('error', 'view')) over (partition by user_id order by event_id) as island from events) select run_id, pos from c where denied qualify row_number() over (partition by run_id, island order by pos) = 3",
    "stream_reasoning": f"with {PIECES} select stream, md5(regexp_replace(t, '(?s)<think>.*?(?:</think>|$)', '', 'g')) as visible, md5(array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), '')) as thinking from pieces",
    "stream_ingest": f"with {LINES} select doc_key, seq, 1 as version, md5(text) as digest from lines where doc_id % 2 <> 0 union all select doc_key, seq, 4, md5(text || '-4') from lines where doc_id % 2 = 0 and seq % 2 = 0 union all select doc_key, seq, 3, md5(text || '-3') from lines where doc_id % 2 = 0 and doc_key not in (select doc_key from lines where seq % 2 = 0)",
    "stream_memories": written(0.85, 100),
    "stream_stale": """with c as (select user_id::varchar as doc_key, event_type = 'view' as pending, epoch_us(ts) as us, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as next, max(epoch_us(ts)) over () as newest from events)
select doc_key, us as since, 'failed' as status from c where pending and coalesce(next - us > 43200000000, newest - 3600000000 > us + 43200000000)""",
    "stream_index": f"""with {CORPUS}, now_ as (select user_id, doc_key, {TOKENS("case when chunk_id % 4 > 0 then 'renewed_' || (chunk_id % 4) || ' ' || text else text end")} as t from corpus where chunk_id % 3 <> 0 or chunk_id % 4 > 0)
select user_id, doc_key, term, count(*) as tf, any_value(dl) as dl from (select user_id, doc_key, len(t) as dl, unnest(t || ['']) as term from now_ where len(t) > 0) group by user_id, doc_key, term""",
    "stream_outcomes": f"with {PLANNED('true')}, told as ({OUTCOMES}) select (1700000000 + query_id * 60) // 3600 * 3600 as start, mode, outcome, degraded, count(*) as n, round(sum(served), 4)::bigint as total from told group by all",
    "stream_audit": f"with {ACTIVITY} select day, count(*) as n, sum(event_id)::bigint as ids, round(sum(value), 4) as total from activity group by 1",
    "stream_counts": f"with {ACTIVITY} select day as start, event_type, count(*) as n, round(sum(value), 4) as total from activity group by all",
    "stream_histogram": f"with {ACTIVITY} select event_type, ((value > 1)::int + (value > 10)::int + (value > 50)::int) as bucket, count(*) as n from activity group by all",
    "stream_rate_windows": BATCH["rate_windows"],
    "stream_quota": BATCH["quota_crossings"],
}
