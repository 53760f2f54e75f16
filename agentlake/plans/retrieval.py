"""Retrieval and its evaluation over documents, benchmark passages and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agentlake.functions import scoring, text as tx
from agentlake.operators import pivots as pv, retrieval as r
from agentlake.plans.relations import CORPUS, PASSAGES, VECTORS, corpus, passages, vector_queries, vectors
from agentlake.sources import buckets
from agentlake.sources.staging import staged, staging_root

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TOKENS = "regexp_extract_all(lower({}), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')".format
BM25 = f"""{CORPUS}, {PASSAGES},
tokens as (select user_id, chunk_id, {TOKENS('text')} as t from corpus),
tf as (select user_id, chunk_id, term, count(*) as tf from (select user_id, chunk_id, unnest(t) as term from tokens) group by all),
dl as (select user_id, chunk_id, len(t) as dl from tokens where len(t) > 0),
stats as (select user_id, count(*) as n, avg(dl) as avgdl from dl group by 1),
df as (select user_id, term, count(*) as df from tf group by all),
asked as (select distinct query_id, user_id, unnest({TOKENS('text')}) as term from passages),
scores as (select query_id, chunk_id, round(sum(greatest(0, ln(1 + (n - df + 0.5::double) / (df + 0.5::double))) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
  from asked join tf using (user_id, term) join dl using (user_id, chunk_id) join stats using (user_id) join df using (user_id, term) group by all),
lexical as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scores where score > 0)"""


@query(f"with {BM25} select query_id, chunk_id, score, rank from lexical where rank <= 5")
def bm25_topk(spark, d):
    return r.bm25_topk(passages(spark, d), corpus(spark, d), 5)


@query(f"with {BM25} select s.user_id, n, avgdl, terms, most from stats s join (select user_id, count(*) as terms, max(df) as most from df group by 1) using (user_id)")
def bm25_index_stats(spark, d):
    found = r.postings(corpus(spark, d))
    p = found.where("term <> ''").groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df")).groupBy("user_id").agg(F.count(F.lit(1)).alias("terms"), F.max("df").alias("most"))
    return r.lexical_stats(found).join(p, "user_id")


COSINE = "case when q.n > 0 and v.n > 0 then list_dot_product(q.v, v.v) / (q.n * v.n) else 0 end"
VECTOR = f"""{VECTORS}, near as (select q.chunk_id as query_id, v.chunk_id, round({COSINE}, 6) as score from vectors q join vectors v using (user_id) where q.chunk_id % 100 = 0)"""


@query(f"with {VECTOR} select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from near qualify rank <= 10")
def vector_topk(spark, d):
    return r.vector_topk(vector_queries(spark, d), vectors(spark, d), 10)


@query(f"with {VECTOR} select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from near qualify rank <= 10")
def pivot_vector_topk(spark, d):
    """The same by groups round pivots, written and read back, whole groups skipped."""
    root, every = f"{staging_root(spark)}/pivots-{uuid.uuid4().hex}", vectors(spark, d)
    for name, part in zip(("members", "pivots"), pv.pivot_index(every)):
        part.write.parquet(f"{root}/{name}")
    return pv.pivot_topk(vector_queries(spark, d), every, spark.read.parquet(f"{root}/members"), spark.read.parquet(f"{root}/pivots"), 10)[0]


def HASHED_OF(rows: str) -> str:  # noqa: N802
    """Hashed vectors of (kind, id, text), cell by cell."""
    return f"""terms as (select kind, id, md5(term) as h from (select kind, id, unnest({TOKENS('text')}) as term from ({rows}))),
cells as (select kind, id, ('0x' || substr(h, 1, 8))::bigint % 64 as bucket, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1 else -1 end)::double as w from terms group by all),
norms as (select kind, id, sqrt(sum(w * w)) as n from cells group by all),
unit as (select kind, id, bucket, case when n > 0 then w / n else w end as w from cells join norms using (kind, id))"""


HASHED = HASHED_OF("select 0 as kind, chunk_id as id, text from corpus union all select 1, query_id, text from passages")


@query(f"with {CORPUS}, {PASSAGES}, {HASHED} select id as chunk_id, count(*) filter (where w <> 0) as cells, round(sum(w * (bucket + 1)), 6) as moment from unit where kind = 0 group by 1")
def hashed_embeddings(spark, d):
    e = r.hashed_embedding(corpus(spark, d), "chunk_id")
    cells = F.size(F.filter("embedding", lambda x: x != 0)).cast("long")
    moment = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return e.select("chunk_id", cells.alias("cells"), F.round(moment, 6).alias("moment"))


HYBRID = f"""{BM25}, {HASHED},
pairs as (select p.query_id, c.chunk_id from passages p join corpus c using (user_id) where c.chunk_id in (select id from unit where kind = 0) and p.query_id in (select id from unit where kind = 1)),
products as (select q.id as query_id, v.id as chunk_id, sum(q.w * v.w) as score from unit q join unit v on q.kind = 1 and v.kind = 0 and q.bucket = v.bucket join pairs on pairs.query_id = q.id and pairs.chunk_id = v.id group by all),
semantic as (select query_id, chunk_id, round(coalesce(score, 0) , 6) as score, row_number() over (partition by query_id order by round(coalesce(score, 0), 6) desc, chunk_id) as rank from pairs left join products using (query_id, chunk_id)),
votes as (select query_id, chunk_id, 1.0::double / (60 + rank) as vote from semantic where rank <= 20 union all select query_id, chunk_id, 1.0::double / (60 + rank) from lexical where rank <= 20),
fused as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, chunk_id, round(sum(vote), 9) as score from votes group by all))"""


def _channels(spark, d, k=20):
    chunks, queries = corpus(spark, d), passages(spark, d)
    lexical = r.bm25_topk(queries, chunks, k)
    own = lambda rows, key: staged(rows.select(key, "user_id").join(r.hashed_embedding(rows, key), key))
    return queries, chunks, r.vector_topk(own(queries, "query_id"), own(chunks, "chunk_id"), k), lexical


@query(f"with {HYBRID} select query_id, chunk_id, score, rank from fused where rank <= 10")
def rrf_fusion(spark, d):
    _, _, vector, lexical = _channels(spark, d)
    return r.rrf([(vector, 1.0), (lexical, 1.0)]).where("rank <= 10")


@query(f"""with {HYBRID}, hits as (select f.query_id, c.*, p.text as query from fused f join passages p using (query_id) join corpus c using (chunk_id) where c.user_id = p.user_id and f.rank <= 20),
scored as (select *, round(len(list_intersect(list_distinct({TOKENS('query')}), list_distinct({TOKENS("case when title_path <> '' and not contains(text, title_path) then title_path || chr(10) || text else text end")})))
  / len(list_distinct({TOKENS('query')}))::double, 6) as rerank_score from hits)
select query_id, chunk_id, doc_key, rerank_score, row_number() over (partition by query_id order by rerank_score desc, chunk_id) as rank from scored qualify rank <= 5""")
def hybrid_retrieval(spark, d):
    queries, chunks = passages(spark, d), corpus(spark, d)
    own = lambda rows, key: rows.select(key, "user_id").join(r.hashed_embedding(rows, key), key)
    return r.retrieve(queries, chunks, own(chunks, "chunk_id"), own(queries, "query_id")).select("query_id", "chunk_id", "doc_key", F.col("score").alias("rerank_score"), "rank")


EMBEDDED = "case when c.title_path <> '' then c.title_path || chr(10) || chr(10) || c.text else c.text end"


def PLANNED(inside: str) -> str:  # noqa: N802
    """Searches with failing channels; ``inside`` says which chunk_id a query_id may see."""
    return f"""{HYBRID}, state as (select query_id, user_id, text, case query_id % 3 when 0 then 'ok' when 1 then 'embed_failed' else 'down' end as vector_state, query_id % 2 = 0 as lexical_ok from passages),
sem as (select query_id, chunk_id, rank from (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from semantic where {inside}) join state using (query_id) where rank <= 20 and vector_state = 'ok'),
lex as (select query_id, chunk_id, rank from (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from lexical where {inside}) join state using (query_id) where rank <= 20 and lexical_ok),
health as (select s.query_id, vector_state, lexical_ok, coalesce(v, 0) as vector_hits, coalesce(x, 0) as lexical_hits from state s left join (select query_id, count(*) as v from sem group by 1) using (query_id) left join (select query_id, count(*) as x from lex group by 1) using (query_id)),
planned as (select query_id, case when vector_state = 'ok' and lexical_ok then case when vector_hits + lexical_hits > 0 then 'hybrid' else 'empty' end when vector_state = 'ok' then case when vector_hits > 0 then 'vector_only' else 'empty' end when lexical_ok and lexical_hits > 0 then 'bm25_fallback' else 'sql_fallback' end as mode,
  case when vector_state = 'ok' and lexical_ok then case when vector_hits + lexical_hits > 0 then 'hybrid_ok' else 'no_hits' end when vector_state = 'ok' then case when vector_hits > 0 then 'vector_only' else 'no_hits' end when lexical_ok and lexical_hits > 0 then case when vector_state = 'embed_failed' then 'embed_failed' else 'bm25_fallback' end else 'sql_fallback' end as outcome,
  not (vector_state = 'ok' and lexical_ok) as degraded, case when vector_state = 'ok' then not lexical_ok and vector_hits = 0 else not (lexical_ok and lexical_hits > 0) end as need_sql from health),
both_ as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from sem union all select * from lex) group by all)),
window_ as (select b.query_id, c.*, s.text as query from both_ b join planned p using (query_id) join state s using (query_id) join corpus c using (chunk_id) where not need_sql and b.rank <= 20 and c.user_id = s.user_id),
ordered as (select query_id, chunk_id, doc_key, round(len(list_intersect(list_distinct({TOKENS('query')}), list_distinct({TOKENS("case when title_path <> '' and not contains(text, title_path) then title_path || chr(10) || text else text end")}))) / len(list_distinct({TOKENS('query')}))::double, 6) as score from window_),
plain as (select query_id, chunk_id, doc_key, row_number() over (partition by query_id order by doc_key, seq, chunk_id) as rank from planned join state s using (query_id) join corpus c using (user_id) where need_sql and {inside} and contains(lower({EMBEDDED}), lower(substr(trim(s.text, ' '), 1, 64)))),
served as (select * from (select query_id, chunk_id, doc_key, row_number() over (partition by query_id order by score desc, chunk_id) as rank, score from ordered union all select query_id, chunk_id, doc_key, rank, 0 from plain) where rank <= 5)"""


OUTCOMES = """select query_id, case when need_sql then 'sql_fallback' else mode end as mode, case when need_sql then 'sql_fallback' when served > 0 then outcome else 'no_hits' end as outcome, degraded, coalesce(served, 0) as served
  from planned left join (select query_id, count(*) as served from served group by 1) using (query_id)"""


def searched(spark, d, scope=None):
    """Channels fail by the number of the query."""
    state = F.when(F.col("query_id") % 3 == 0, "ok").when(F.col("query_id") % 3 == 1, "embed_failed").otherwise("down")
    queries, chunks = passages(spark, d), corpus(spark, d)
    own = lambda rows, key: rows.select(key, "user_id").join(r.hashed_embedding(rows, key), key)
    health = queries.select("query_id", state.alias("vector_state"), (F.col("query_id") % 2 == 0).alias("lexical_ok"))
    return r.search(queries, chunks, own(chunks, "chunk_id"), own(queries, "query_id"), health=health, scope=scope and scope(queries, chunks))


@query(f"with {PLANNED('true')} select query_id, chunk_id, doc_key, rank, score from served")
def search_hits(spark, d):
    return searched(spark, d)[0]


@query(f"with {PLANNED('true')} {OUTCOMES}")
def search_outcomes(spark, d):
    return searched(spark, d)[1]


@query(f"with {PLANNED('(query_id % 4 >= 2 or chunk_id % 3 = 0)')} select query_id, chunk_id, doc_key, rank, score, outcome from served join ({OUTCOMES}) using (query_id)")
def scoped_search(spark, d):
    """Half of the queries see every third document only, in whatever channel serves them."""
    hits, outcomes = searched(spark, d, lambda queries, chunks: queries.where("query_id % 4 < 2").select("query_id", "user_id").join(chunks.where("chunk_id % 3 = 0").select("user_id", "doc_key"), "user_id").select("query_id", "doc_key"))
    return hits.join(outcomes.select("query_id", "outcome"), "query_id")


CHANGED = "select chunk_id, user_id, doc_key, 0 as seq, title_path, case when chunk_id % 3 = 0 then 'renewed ' || text else text end as text from corpus where chunk_id % 7 <> 0"


@query(f"with {CORPUS}, now_ as ({CHANGED}) select user_id, doc_key, term, count(*) as tf, any_value(dl) as dl from (select user_id, doc_key, len(t) as dl, unnest(t || ['']) as term from (select user_id, doc_key, {TOKENS('text')} as t from now_) where len(t) > 0) group by user_id, doc_key, term")
def updated_index(spark, d):
    """The stored index after each third document changed and each seventh was deleted."""
    c = corpus(spark, d)
    changed = c.where("chunk_id % 3 = 0 and chunk_id % 7 <> 0").withColumn("text", F.concat(F.lit("renewed "), "text"))
    return r.updated_index(r.lexical_index(c), changed, c.where("chunk_id % 7 = 0")).select("user_id", "doc_key", "term", "tf", "dl")


@query(f"with {BM25} select query_id, chunk_id, score, rank from lexical where rank <= 5")
def indexed_bm25_topk(spark, d):
    """By a stored index alone, read back: postings with their weights in folders by their term, and the highest weights of blocks."""
    root = f"{staging_root(spark)}/index-{uuid.uuid4().hex}"
    weighed, blocks = r.weighted_index(staged(r.lexical_index(corpus(spark, d))))
    buckets.store(weighed, f"{root}/postings", ("term",))
    buckets.store(blocks, f"{root}/blocks", ("term",))
    return r.pruned_topk(passages(spark, d), buckets.stored(spark, f"{root}/postings"), buckets.stored(spark, f"{root}/blocks"), 5)[0].select("query_id", "chunk_id", "score", "rank")


@query(f"with {BM25} select l.query_id, l.chunk_id, l.rank, c.doc_key, c.user_id, length(c.text) as n_chars from lexical l join passages p using (query_id) join corpus c on c.chunk_id = l.chunk_id and c.user_id = p.user_id where l.rank <= 10")
def hydrate(spark, d):
    queries, chunks = passages(spark, d), corpus(spark, d)
    return r.hydrate(r.bm25_topk(queries, chunks, 10), queries, chunks).select("query_id", "chunk_id", "rank", "doc_key", "user_id", F.length("text").alias("n_chars"))


@query(f"with {VECTORS}, {CORPUS} select q.chunk_id as query_id, v.chunk_id, q.chunk_id % 10 as user_id, v.chunk_id % 10 as owner from vectors q join vectors v on v.chunk_id between q.chunk_id and q.chunk_id + 4 where q.chunk_id % 100 = 0 and v.chunk_id % 10 <> q.chunk_id % 10")
def tenant_violations(spark, d):
    """Hits that a faulty channel would give: the next vectors, whosoever they are."""
    owner = lambda rows, key: rows.withColumn("user_id", F.col(key) % 10)
    q, v = owner(vector_queries(spark, d), "query_id"), owner(vectors(spark, d), "chunk_id")
    ranked = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("query_id", (F.col("query_id") + F.col("i")).alias("chunk_id"))
    return r.violations(ranked, q, v)


@query(f"with {BM25} select l.query_id, l.chunk_id, coalesce(d.source, '') as title, coalesce(d.lang, '') as source_path from lexical l left join documents d on d.doc_id = l.chunk_id and d.doc_id % 3 <> 0 where rank <= 5")
def citations(spark, d):
    """Two thirds of the documents have a row with a title."""
    queries, chunks = passages(spark, d), corpus(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 3 <> 0").select((F.col("doc_id") % 10).alias("user_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_key"), F.col("source").alias("title"), F.col("lang").alias("source_path"))
    return r.with_citations(r.hydrate(r.bm25_topk(queries, chunks, 5), queries, chunks), docs).select("query_id", "chunk_id", "title", "source_path")


@query(f"with {BM25} select query_id, chunk_id, score from (select *, max(score) over (partition by query_id) as top from lexical where rank <= 20) where score >= 0.35::double * top")
def relative_floor(spark, d):
    return r.relative_floor(r.bm25_topk(passages(spark, d), corpus(spark, d), 20), 0.35).select("query_id", "chunk_id", "score")


@query(f"with {BM25} select query_id, chunk_id, rank from lexical join corpus using (chunk_id) where rank <= 20 and (query_id % 2 = 1 or chunk_id % 4 = 0)")
def scope_filter(spark, d):
    """Even queries see only every fourth document."""
    queries, chunks = passages(spark, d), corpus(spark, d)
    scope = queries.where("query_id % 2 = 0").select("query_id", "user_id").join(chunks.where("chunk_id % 4 = 0").select("user_id", "doc_key"), "user_id").select("query_id", "doc_key")
    return r.scoped(r.hydrate(r.bm25_topk(queries, chunks, 20), queries, chunks), scope).select("query_id", "chunk_id", "rank")


@query(f"with {BM25} select query_id, chunk_id, rank, (count(*) over (partition by query_id) - row_number() over (partition by query_id order by rank) + 1)::double as score from lexical where rank <= 7")
def score_fill(spark, d):
    return r.filled_scores(r.bm25_topk(passages(spark, d), corpus(spark, d), 7).withColumn("score", F.lit(0.0))).select("query_id", "chunk_id", "rank", "score")


@query(f"""with {CORPUS}, {PASSAGES}, found as (select query_id, chunk_id, doc_key, row_number() over (partition by query_id order by doc_key, seq, chunk_id) as rank
  from passages p join corpus c using (user_id) where contains(lower({EMBEDDED}), lower(substr(trim(p.text, ' '), 1, 64))) and trim(p.text, ' ') <> '') select * from found where rank <= 20""")
def substring_search(spark, d):
    return r.substring_search(passages(spark, d), corpus(spark, d))


@query(f"""with {PASSAGES}, health as (select query_id, case query_id % 3 when 0 then 'ok' when 1 then 'embed_failed' else 'down' end as vector_state, query_id % 2 = 0 as lexical_ok, query_id % 5 as vector_hits, query_id % 7 as lexical_hits from passages)
select *, case when vector_state = 'ok' and lexical_ok then case when vector_hits + lexical_hits > 0 then 'hybrid' else 'empty' end when vector_state = 'ok' then case when vector_hits > 0 then 'vector_only' else 'empty' end when lexical_ok and lexical_hits > 0 then 'bm25_fallback' else 'sql_fallback' end as mode,
  case when vector_state = 'ok' and lexical_ok then case when vector_hits + lexical_hits > 0 then 'hybrid_ok' else 'no_hits' end when vector_state = 'ok' then case when vector_hits > 0 then 'vector_only' else 'no_hits' end when lexical_ok and lexical_hits > 0 then case when vector_state = 'embed_failed' then 'embed_failed' else 'bm25_fallback' end else 'sql_fallback' end as outcome,
  not (vector_state = 'ok' and lexical_ok) as degraded,
  case when vector_state = 'ok' then not lexical_ok and vector_hits = 0 else not (lexical_ok and lexical_hits > 0) end as need_sql from health""")
def channel_plan(spark, d):
    state = F.when(F.col("query_id") % 3 == 0, "ok").when(F.col("query_id") % 3 == 1, "embed_failed").otherwise("down")
    health = passages(spark, d).select("query_id", state.alias("vector_state"), (F.col("query_id") % 2 == 0).alias("lexical_ok"), (F.col("query_id") % 5).alias("vector_hits"), (F.col("query_id") % 7).alias("lexical_hits"))
    return r.channel_plan(health)


@query(f"""with {BM25} select query_id, string_agg(case when rank = 2 then 'a title' else title_path end || case when rank = 3 then ' p.7' else '' end || ' — ' || case when rank = 1 then 'a/b.md' else doc_key end, chr(10) order by rank) as citations,
  '[' || string_agg('{{"rank":' || rank || ',"chunk_id":' || chunk_id || '}}', ',' order by rank) || ']' as payload from lexical join corpus using (chunk_id) where rank <= 3 group by 1""")
def citation_lines(spark, d):
    queries, chunks = passages(spark, d), corpus(spark, d)
    hits = r.hydrate(r.bm25_topk(queries, chunks, 3), queries, chunks)
    only = lambda rank, value: F.when(F.col("rank") == rank, F.lit(value))
    return r.citation_lines(hits.withColumns({"title": only(2, "a title"), "page": only(3, 7), "source_path": only(1, "a/b.md"), "title_path": F.when(F.col("rank") != 2, F.col("title_path"))}))


@query(f"""with {CORPUS} select chunk_id, length(case when title_path <> '' and not contains(text, title_path) then title_path || chr(10) || text else text end) as index_chars,
  length(case when title_path <> '' then title_path || chr(10) || chr(10) || text else text end) as embed_chars, doc_key || '#' || seq as chunk_key from corpus""")
def index_texts(spark, d):
    c = corpus(spark, d)
    return c.select("chunk_id", F.length(tx.index_text(F.col("title_path"), F.col("text"))).alias("index_chars"), F.length(tx.embed_text(F.col("title_path"), F.col("text"))).alias("embed_chars"), tx.chunk_key(F.col("doc_key"), F.col("seq")).alias("chunk_key"))


@query(f"""with {CORPUS}, {PASSAGES} select query_id, chunk_id, round(len(list_intersect(list_distinct({TOKENS('p.text')}), list_distinct({TOKENS('c.text')}))) / greatest(len(list_distinct({TOKENS('p.text')})), 1)::double, 6) as overlap
  from passages p join corpus c using (user_id)""")
def lexical_overlap(spark, d):
    terms = lambda df, key, name: df.select(key, "user_id", tx.term_set(F.col("text")).alias(name))
    joined = terms(passages(spark, d), "query_id", "q").join(terms(corpus(spark, d), "chunk_id", "c"), "user_id")
    return joined.select("query_id", "chunk_id", F.round(scoring.lexical_overlap(F.col("q"), F.col("c")), 6).alias("overlap"))


@query(f"with {CORPUS}, {PASSAGES}, {HASHED} select user_id, count(*) as chunks, count(u.id) as indexed from corpus left join (select distinct id from unit where kind = 0) u on u.id = chunk_id group by 1")
def rebuild_index(spark, d):
    return r.rebuild_index(corpus(spark, d))[1]


@query(f"with {CORPUS} select doc_key, seq, user_id, length(text) as n_chars from corpus")
def chunk_scan(spark, d):
    """Every chunk; of a table written by ``sources.tables.write_chunks``, asking for some users opens their folders only."""
    return corpus(spark, d).select("doc_key", "seq", "user_id", F.length("text").alias("n_chars"))
