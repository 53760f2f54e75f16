"""Readers and writers: what the library writes of the tables and reads again, beside the SQL of the rows themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agentlake.plans.relations import ACTIVITY, activity, table
from agentlake.sources import tables as st
from agentlake.sources.staging import staging_root


def _root(spark) -> str:
    return f"{staging_root(spark)}/stored-{uuid.uuid4().hex}"


def stored_trajectories(spark, d):
    """Each user's day as a run of JSON lines, read back as events in their order."""
    root, e = _root(spark), activity(spark, d)
    event = F.struct(F.col("event_type").alias("type"), F.unix_micros("ts").alias("us"), F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("string").alias("call_id"), (~F.col("ok")).alias("is_error"))
    runs = e.groupBy("run_id").agg((F.min(F.unix_micros("ts")) / 1e6).alias("started_at"), F.array_sort(F.collect_list(F.struct("ts", "event_id", event.alias("e")))).alias("es"))
    st.write_trajectories(runs.select("run_id", "started_at", F.transform("es", lambda x: x["e"].dropFields("us")).alias("events")), root)
    good, _ = st.read_trajectories(spark, root)
    return st.run_events(good).select("run_id", "pos", "type", "user_id", "call_id", "is_error")


def stored_audit(spark, d):
    root = _root(spark)
    st.write_audit(activity(spark, d).select("event_id", "ts", "event_type"), root)
    return spark.read.parquet(root).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def stored_chunks(spark, d):
    """Documents in buckets of their user, read back."""
    root = _root(spark)
    st.write_chunks(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("user_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")), root)
    return st.read_chunks(spark, root, None).select("doc_id", "user_id", "digest")


def stored_golden(spark, d):
    """Passages as golden files of a hundred cases; every fifth has no key, every seventh a category of its own."""
    root, i = _root(spark), F.col("item_id")
    keys = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("doc-"), i, F.lit("#0"))))
    case = F.struct(F.concat(F.lit("c"), i).alias("id"), F.col("text").alias("query"), i.alias("user_id"), keys.alias("gold_chunk_keys"), F.when(i % 7 == 0, "other").otherwise("happy_path").alias("category"))
    files = table(spark, d, "benchmark").groupBy(F.floor(i / 100).alias("file")).agg(F.collect_list(case).alias("cases"))
    files.write.partitionBy("file").json(root)
    cases, rejected = st.load_golden(spark, root)
    return cases.select("case_id", F.lit("").alias("reason")).unionByName(rejected.select("case_id", "reason"))


def stored_tasks(spark, d):
    """First turns of conversations as task files, a folder for each hundred of them, numbered by file and id."""
    root, i = _root(spark), F.col("conv_id")
    task = F.struct(F.format_string("t%09d", i).alias("id"), F.coalesce("text", F.lit("")).alias("prompt"), F.concat(F.lit("c"), i % 3).alias("category"))
    first = table(spark, d, "conversations").where("turn = 0")
    files = first.groupBy(F.format_string("%06d", F.floor(i / 100)).alias("file")).agg(F.to_json(F.collect_list(task)).alias("value"))
    files.repartition("file").write.partitionBy("file").text(root)
    return st.load_tasks(spark, root).select("id", F.col("at").alias("place"), F.md5("prompt").alias("digest"), "category")


def stored_inputs(spark, d):
    """Documents as files of their language, of a kind that is taken in or not; how many of each, and whether any is empty."""
    root = _root(spark)
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition("lang")
    docs.write.partitionBy("lang").text(f"{root}/plain")
    docs.write.partitionBy("lang").csv(f"{root}/tables")
    docs.write.partitionBy("lang").json(f"{root}/records")
    found = st.list_inputs(spark, root).withColumns({"lang": F.regexp_extract("path", "/lang=([^/]*)/", 1), "kind": F.regexp_extract("path", "/(plain|tables|records)/", 1)})
    return found.groupBy("kind", "lang", "supported").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") > 0).alias("filled"))


QUERIES = {f.__name__: f for f in (stored_trajectories, stored_audit, stored_chunks, stored_golden, stored_tasks, stored_inputs)}
SQL = {
    "stored_trajectories": f"with {ACTIVITY} select run_id, (row_number() over (partition by run_id order by ts, event_id) - 1)::int as pos, event_type as type, user_id::varchar as user_id, event_id::varchar as call_id, not ok as is_error from activity",
    "stored_audit": f"with {ACTIVITY} select day, event_type, count(*) as n, sum(event_id)::bigint as ids from activity group by all",
    "stored_chunks": "select doc_id, doc_id % 100 as user_id, md5(coalesce(text, '')) as digest from documents",
    "stored_golden": "select 'c' || item_id as case_id, case when item_id % 7 = 0 then 'category' when item_id % 5 = 0 then 'no gold' else '' end as reason from benchmark",
    "stored_tasks": "select format('t{:09d}', conv_id) as id, row_number() over (order by conv_id) - 1 as place, md5(coalesce(text, '')) as digest, 'c' || (conv_id % 3) as category from conversations where turn = 0",
    "stored_inputs": "select kind, lang, kind <> 'records' as supported, 1 as files, 1 as filled from (select distinct coalesce(lang, 'none') as lang from documents), (values ('plain'), ('tables'), ('records')) t(kind)",
}
