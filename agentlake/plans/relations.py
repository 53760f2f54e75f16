"""The library's relations over the generated tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agentlake.sources.staging import spread

TENANTS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % TENANTS).alias("user_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_key"),
        F.lit(0).alias("seq"), F.col("source").alias("title_path"), F.coalesce("text", F.lit("")).alias("text"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % TENANTS).alias("user_id"), "text")


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that isn't blank as a chunk of its document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    return lines.where(F.trim("text") != "").select((F.col("doc_id") % TENANTS).alias("user_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_key"), "doc_id", F.col("seq").cast("long").alias("seq"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one user's, so that a query meets each of them."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(0).cast("long").alias("user_id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector, against all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("user_id"), "embedding")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a real timestamp and the role each type plays: tool calls, usage, sign-ins."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type").isin("view", "click", "error"), "tool_call").when(F.col("event_type") == "purchase", "usage").otherwise("auth")
    return e.withColumns({"event": kind, "ok": F.col("event_type") != "error", "day": F.date_format("ts", "yyyy-MM-dd"), "month": F.date_format("ts", "yyyy-MM"), "run_id": F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd"))})


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(spark, sf_dir).where("event = 'usage'").select(
        "event_id", "ts", "day", "month", "user_id", F.concat(F.lit("vendor/m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.floor("value").alias("input_tokens"), F.floor(F.col("value") / 2).alias("output_tokens")
    )


# Prices per million tokens, by model without the provider's prefix.
PRICES = (("m0", 2.0, 6.0), ("m1", 0.5, 1.5), ("m2", 10.0, 30.0), ("m3", 0.25, 1.0))

CORPUS = "corpus as (select doc_id as chunk_id, doc_id % 10 as user_id, 'doc-' || doc_id as doc_key, 0 as seq, source as title_path, coalesce(text, '') as text from documents)"
PASSAGES = "passages as (select item_id as query_id, item_id % 10 as user_id, text from benchmark)"
LINES = "lines as (select doc_id % 10 as user_id, 'doc-' || doc_id as doc_key, doc_id, (i - 1)::bigint as seq, l[i] as text from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), unnest(range(1, len(l) + 1)) as u(i) where trim(l[i], ' ') <> '')"
VECTORS = "vectors as (select vec_id as chunk_id, 0 as user_id, embedding::double[] as v, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)"
ACTIVITY = """activity as (select *, case when event_type in ('view', 'click', 'error') then 'tool_call' when event_type = 'purchase' then 'usage' else 'auth' end as event,
  event_type <> 'error' as ok, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m') as month, user_id || '-' || strftime(ts, '%Y%m%d') as run_id from events)"""
USAGE = f"{ACTIVITY}, usage as (select event_id, ts, day, month, user_id, 'vendor/m' || (user_id % 5) as model, floor(value)::bigint as input_tokens, floor(value / 2)::bigint as output_tokens from activity where event = 'usage')"
PRICE_SQL = "prices as (select * from (values ('m0', 2.0::double, 6.0::double), ('m1', 0.5::double, 1.5::double), ('m2', 10.0::double, 30.0::double), ('m3', 0.25::double, 1.0::double)) t(model, price_in, price_out))"
