"""Hybrid retrieval for a table of queries: lexical and vector channels, fusion, hydration, rerank.

Chunks have chunk_id, user_id, doc_key, seq, title_path, text; queries have query_id, user_id, text.  Hits have
query_id, chunk_id, score and, once ranked, rank.  Ties go to the smaller chunk_id everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agentlake.functions import scoring, text as tx
from agentlake.operators import tiles
from agentlake.operators.substrings import containing
from agentlake.sources.staging import staged


def topk(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(chunks: DataFrame, terms: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """user_id, chunk_id, term, tf, dl, and the columns ``keep``; chunks without terms are left out.

    With ``terms`` (user_id, term), only theirs leave the scan's stage: they are kept before anything is counted.  Beside
    them every chunk of these users has a row of the empty term, so that one reading of the texts gives lengths and postings.
    """
    by = ["user_id", "chunk_id", *keep]
    sized = chunks.select(*by, tx.tokens(F.col("text")).alias("terms"))
    # An outer explode has no filter inferred below it, so each text meets the tokenizer once.
    rows = sized.select(*by, F.size("terms").alias("dl"), F.explode_outer(F.when(F.size("terms") > 0, F.concat("terms", F.array(F.lit(""))))).alias("term")).where("term is not null")
    if terms is not None:
        rows = rows.join(_wanted(terms, terms.select("user_id").distinct()), ["user_id", "term"], "left_semi")
    return rows.groupBy(*by, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def _wanted(terms: DataFrame, users: DataFrame) -> DataFrame:
    return terms.unionByName(users.withColumn("term", F.lit("")))


def lexical_index(chunks: DataFrame) -> DataFrame:
    """The postings of all terms with their doc_key: a table to store once, and to search without the texts."""
    return postings(chunks, keep=("doc_key",))


def updated_index(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``index`` after the documents of ``changed`` chunks were replaced, and those of ``removed`` (user_id, doc_key) deleted."""
    gone = changed.select("user_id", "doc_key").unionByName(removed.select("user_id", "doc_key")) if removed is not None else changed.select("user_id", "doc_key")
    return index.join(gone.distinct(), ["user_id", "doc_key"], "left_anti").unionByName(lexical_index(changed))


def lexical_stats(found: DataFrame) -> DataFrame:
    """user_id, n, avgdl over the chunks that have terms, from postings."""
    return found.where("term = ''").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "user_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))


def bm25_scores(queries: DataFrame, chunks: DataFrame | None, index: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, score, and the chunk's columns ``keep``, of every chunk of the query's user that shares a term with it; by ``index`` where there is one.

    Only postings of asked terms survive the semi-join; they are written once, and document frequencies and lengths
    follow from them.
    """
    asked = query_terms(queries)
    wanted = asked.select("user_id", "term").distinct()
    if index is None:
        found = staged(postings(chunks, wanted, keep))
    else:
        found = staged(index.join(_wanted(wanted, asked.select("user_id").distinct()), ["user_id", "term"], "left_semi").select("user_id", "chunk_id", *keep, "dl", "term", "tf"))
    hit = found.where("term <> ''")
    df = hit.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = scoring.bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), scoring.idf(F.col("n"), F.col("df")))
    weighed = hit.join(df, ["user_id", "term"]).join(lexical_stats(found), "user_id").select("user_id", "term", "chunk_id", *keep, weight.alias("w"))
    return asked.join(weighed, ["user_id", "term"]).groupBy("query_id", "chunk_id", *keep).agg(F.sum("w").alias("score"))


def bm25_topk(queries: DataFrame, chunks: DataFrame | None, k: int = 20, index: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of each query; of queries that ``scope`` (query_id, doc_key) narrows, the ``k`` best inside it."""
    scores = bm25_scores(queries, chunks, index, ("doc_key",) if scope is not None else ()).where("score > 0").withColumn("score", F.round("score", 6))
    return topk(scores if scope is None else scoped(scores, scope).drop("doc_key"), k)


#: Chunks whose postings make a block; blocks of a query that are scored before the others are held against its k-th score.
BLOCK_CHUNKS, FIRST_BLOCKS = 64, 4


def weighted_index(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, blocks) of a lexical index: each posting with its BM25 weight w and its block, and the highest weight of each (user_id, term, block).

    Both are tables to store; a block holds about ``BLOCK_CHUNKS`` chunks of a user, by a hash of the chunk.
    """
    hit = index.where("term <> ''")
    df = hit.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = scoring.bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), scoring.idf(F.col("n"), F.col("df")))
    block = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / BLOCK_CHUNKS)).cast("int")
    weighed = hit.join(df, ["user_id", "term"]).join(lexical_stats(index), "user_id").select("user_id", "term", block.alias("block"), "chunk_id", weight.alias("w")).where("w > 0")
    return weighed, weighed.groupBy("user_id", "term", "block").agg(F.max("w").alias("most"))


def pruned_topk(queries: DataFrame, weighed: DataFrame, blocks: DataFrame, k: int = 20, first: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(ranked hits, per query: blocks, scored) as ``bm25_topk``, from a stored weighted index, skipping blocks that cannot hold one of the first ``k``.

    No chunk of a block scores more than the highest weights of the query's terms there, added up.  The ``first`` blocks by that
    bound are scored; of the others only those whose bound reaches the k-th score so far are.
    """
    asked = query_terms(queries)
    by = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = asked.join(blocks, ["user_id", "term"]).groupBy("query_id", "user_id", "block").agg(F.sum("most").alias("bound"))
    bounds = staged(bounds.withColumn("place", F.row_number().over(by)))

    def scored(wanted: DataFrame) -> DataFrame:
        terms = wanted.select("query_id", "block").join(asked, "query_id")
        scores = terms.join(weighed, ["user_id", "term", "block"]).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))
        return topk(scores.withColumn("score", F.round("score", 6)).where("score > 0"), k)

    early = staged(scored(bounds.where(F.col("place") <= first)))
    least = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    # Scores are rounded, and sums may differ in their last digits.
    open_ = staged(bounds.where(F.col("place") > first).join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-5))
    late = scored(open_)
    hits = topk(early.unionByName(late).drop("rank"), k)
    told = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("place") <= first).alias("begun"))
    return hits, told.join(open_.groupBy("query_id").agg(F.count(F.lit(1)).alias("more")), "query_id", "left").select("query_id", "blocks", (F.col("begun") + F.coalesce("more", F.lit(0))).alias("scored"))


def vector_scores(queries: DataFrame, vectors: DataFrame, splits: int = 16) -> DataFrame:
    """query_id, score and the columns of ``vectors`` but its embedding: cosine of each query with the vectors of its user.

    Norms are taken once per side.  A user's vectors are dealt into ``splits`` parts, each of which meets its own copy of
    the queries, so a user of very many vectors isn't one key.
    """
    side = lambda df, v: df.withColumn("norm", scoring.norm(F.col("embedding"))).withColumnsRenamed({"embedding": v, "norm": f"{v}_norm"})
    dealt = side(vectors, "v").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(splits)).cast("int"))
    asked = side(queries.select("query_id", "user_id", "embedding"), "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    fits = (F.size("v") == F.size("q")) & (F.col("v_norm") > 0) & (F.col("q_norm") > 0)
    score = F.when(fits, scoring.dot(F.col("v"), F.col("q")) / (F.col("v_norm") * F.col("q_norm"))).otherwise(F.lit(0.0))
    return dealt.join(asked, ["user_id", "part"]).select("query_id", *(c for c in vectors.columns if c != "embedding"), F.round(score, 6).alias("score"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest vectors of the query's user, by matrix products of tiles; each tile keeps its own ``k`` before they are shuffled.

    Both tables are read twice (sizes first), so what is costly to make is better staged.
    """
    asked, rows = (df.select(F.col(key).alias("id"), "user_id", F.col("embedding").alias("load")) for df, key in ((queries, "query_id"), (vectors, "chunk_id")))

    def nearest(user_id, left, right, alone):
        if len(left) and len(right):
            for at, of, value in tiles.nearest(left["load"], right["load"], k):
                yield tiles.batch(query_id=left["id"].take(at).combine_chunks(), chunk_id=right["id"].take(of).combine_chunks(), score=value)

    ids = (df.schema["id"].dataType.simpleString() for df in (asked, rows))
    return topk(tiles.pairs(asked, rows, nearest, "query_id {}, chunk_id {}, score double".format(*ids)), k)


def hashed_embedding(rows: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """key, embedding: signed counts of hashed terms at unit length; rows without terms are left out.

    Each row by itself: its terms' cells are sorted, so that equal ones stand together, and the lengths of their runs fill the vector.
    """
    code = lambda h: F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)) * 2 + F.conv(F.substring(h, 10, 1), 16, 10).cast("long") % 2
    # The condition stands behind an outer explode, as Catalyst would copy it, terms and all, below the scan's repartitioning.
    cells = rows.select(key, F.explode_outer(F.array(F.sort_array(F.transform(tx.embedding_terms(F.col("text")), lambda t: code(F.md5(t)))))).alias("cells")).where(F.size("cells") > 0)
    # A cell that differs from the one before begins a run; even codes count up, odd ones down.
    at = F.filter(F.sequence(F.lit(1), F.size("cells")), lambda i: (i == 1) | (F.get("cells", i - 1) != F.get("cells", i - 2)))
    begun = cells.select(key, "cells", at.alias("at"))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("cells") + 1))
    runs = begun.select(key, F.map_from_arrays(F.transform("at", lambda i: F.get("cells", i - 1)), F.zip_with("at", ends, lambda a, b: (b - a).cast("double"))).alias("runs"))
    count = lambda c: F.coalesce(F.try_element_at("runs", c), F.lit(0.0))
    vector = runs.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: count(i * 2) - count(i * 2 + 1)).alias("v"))
    sized = vector.select(key, "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
    return sized.select(key, F.transform("v", lambda x: x / F.when(F.col("n") > 0, F.col("n")).otherwise(1.0)).alias("embedding"))


def rrf(channels: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked hits; a channel of weight 0 is left out."""
    if k <= 0 or any(w < 0 for _, w in channels):
        raise ValueError("k must be positive and weights not negative")
    votes = [c.select("query_id", "chunk_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("vote")) for c, w in channels if w]
    every = votes[0]
    for v in votes[1:]:
        every = every.unionByName(v)
    fused = every.groupBy("query_id", "chunk_id").agg(F.round(F.sum("vote"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def relative_floor(hits: DataFrame, ratio: float) -> DataFrame:
    """Hits that reach ``ratio`` times their query's best score."""
    return hits.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("score") >= ratio * F.col("top")).drop("top")


def scoped(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits inside the (query_id, doc_key) rows of ``scope``; queries without such rows are not narrowed."""
    narrowed = scope.select("query_id").distinct()
    free = hits.join(narrowed, "query_id", "left_anti")
    return free.unionByName(hits.join(scope, ["query_id", "doc_key"], "left_semi").select(*free.columns))


def hydrate(ranked: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked ids with their chunks; ids that are gone, or belong to another user, drop out."""
    owned = ranked.join(queries.select("query_id", "user_id"), "query_id")
    return owned.join(chunks, ["chunk_id", "user_id"])


def violations(ranked: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk belongs to someone else."""
    owned = ranked.join(queries.select("query_id", "user_id"), "query_id")
    return owned.join(chunks.select("chunk_id", F.col("user_id").alias("owner")), "chunk_id").where("owner <> user_id").select("query_id", "chunk_id", "user_id", "owner")


def with_citations(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Title and source path of each hit's document, empty where it has no row."""
    cited = hits.join(docs.select("user_id", "doc_key", "title", "source_path"), ["user_id", "doc_key"], "left")
    return cited.fillna("", ["title", "source_path"])


def filled_scores(hits: DataFrame) -> DataFrame:
    """Where all scores of a query are 0, the position from the end instead."""
    w = Window.partitionBy("query_id")
    by_place = (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy("rank")) + 1).cast("double")
    return hits.withColumn("score", F.when(F.max(F.abs("score")).over(w) == 0, by_place).otherwise(F.col("score")))


def channel_plan(health: DataFrame) -> DataFrame:
    """mode, outcome, degraded, need_sql from vector_state, lexical_ok, vector_hits and lexical_hits of each query.

    vector_state is ok, embed_failed or down.  A healthy channel without hits is not a failure while both are healthy.
    """
    vec, lex = F.col("vector_state") == "ok", F.col("lexical_ok")
    v, x = F.col("vector_hits") > 0, F.col("lexical_hits") > 0
    pick = lambda *cases, rest: _cases(cases, rest)
    rows = ((vec & lex & (v | x), "hybrid", "hybrid_ok"), (vec & lex, "empty", "no_hits"), (vec & v, "vector_only", "vector_only"), (vec, "empty", "no_hits"), (lex & x & (F.col("vector_state") == "embed_failed"), "bm25_fallback", "embed_failed"), (lex & x, "bm25_fallback", "bm25_fallback"))
    return health.withColumns({
        "mode": pick(*((c, m) for c, m, _ in rows), rest="sql_fallback"), "outcome": pick(*((c, o) for c, _, o in rows), rest="sql_fallback"),
        "degraded": ~(vec & lex), "need_sql": ~(vec & lex) & ~(vec & v) & ~(~vec & lex & x),
    })


def _cases(cases, rest: str) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(rest)


def substring_search(queries: DataFrame, chunks: DataFrame, k: int = 20, cut: int = 64, scope: DataFrame | None = None) -> DataFrame:
    """Chunks of the user whose text, title or both as they are embedded hold the trimmed, cut query, whatever the case; by doc_key and seq."""
    needles = queries.select("query_id", "user_id", F.lower(F.substring(F.trim("text"), 1, cut)).alias("needle"))
    # What is embedded begins with the title and ends with the text, so it holds whatever one of them does.
    hay = chunks.select("chunk_id", "user_id", F.lower(tx.embed_text(F.col("title_path"), F.coalesce("text", F.lit("")))).alias("text"))
    found = containing(needles, hay, "query_id", "chunk_id", ("user_id",)).join(chunks.select("chunk_id", "doc_key", "seq"), "chunk_id")
    found = found if scope is None else scoped(found, scope)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_key", "seq", "chunk_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "chunk_id", "doc_key", "rank")


def rerank(hits: DataFrame, score: Column, final_k: int, candidates: int = 20) -> DataFrame:
    """The first max(final_k, candidates) hits ordered anew by ``score``; where that is null, the old order stays and is marked."""
    window = hits.where(F.col("rank") <= max(final_k, candidates)).withColumn("rerank_score", score)
    q = Window.partitionBy("query_id")
    failed = F.max(F.col("rerank_score").isNull()).over(q)
    ready = window.withColumn("rerank_failed", failed).withColumn("key", F.when(F.col("rerank_failed"), -F.col("rank").cast("double")).otherwise(F.col("rerank_score")))
    place = F.row_number().over(q.orderBy(F.col("key").desc(), "chunk_id"))
    return ready.withColumn("rank", place).where(F.col("rank") <= final_k).drop("key")


def overlap_score(query: Column, title_path: Column, text: Column) -> Column:
    """The default reranker: the share of the query's terms that the chunk has."""
    return F.round(scoring.lexical_overlap(tx.term_set(query), tx.term_set(tx.index_text(title_path, text))), 6)


def _renumbered(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))


def search(
    queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, candidates: int = 20, weight: float = 1.0,
    health: DataFrame | None = None, scope: DataFrame | None = None, index: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits, outcomes) of queries whose channels may fail.

    hits: query_id, chunk_id, doc_key, rank, score.  outcomes: query_id, mode, outcome, degraded, served.  ``health`` has
    vector_state and lexical_ok by query_id (none: both work); a query whose channels are both unusable is served by
    substrings of texts and titles; its outcome says so even where nothing is found, as an outage must not look like a miss,
    and ``served`` counts what it got.  ``scope`` (query_id, doc_key) narrows a query to documents in every channel before its
    first ``candidates``.  A blank query finds nothing.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    asked = queries.where(~blank)
    state = asked.select("query_id")
    state = state.join(health.select("query_id", "vector_state", "lexical_ok"), "query_id", "left") if health is not None else state.withColumns({"vector_state": F.lit("ok"), "lexical_ok": F.lit(True)})
    state = staged(state.fillna("ok", ["vector_state"]).withColumn("lexical_ok", F.coalesce("lexical_ok", F.lit(True))))
    of = lambda rows, condition: rows.join(state.where(condition).select("query_id"), "query_id", "left_semi")
    narrowed = (lambda hits: scoped(hits, scope)) if scope is not None else (lambda hits: hits)
    owned = vectors.join(chunks.select("chunk_id", "doc_key"), "chunk_id") if scope is not None else vectors
    near = narrowed(vector_scores(of(query_vectors, "vector_state = 'ok'"), owned))
    vector = staged(topk(near.select("query_id", "chunk_id", "score"), candidates))
    lexical = staged(bm25_topk(of(asked, "lexical_ok"), chunks, candidates, index, scope))

    number = lambda hits, name: hits.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    plan = staged(channel_plan(state.join(number(vector, "vector_hits"), "query_id", "left").join(number(lexical, "lexical_hits"), "query_id", "left").fillna(0, ["vector_hits", "lexical_hits"])))
    ranked = rrf([(vector, 1.0), (lexical, weight)]).join(plan.where("not need_sql").select("query_id"), "query_id", "left_semi")
    found = hydrate(ranked.where(F.col("rank") <= max(k, candidates)), queries, chunks)
    hits = _renumbered(found).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    best = rerank(hits, overlap_score(F.col("query"), F.col("title_path"), F.col("text")), k, candidates)
    plain = substring_search(asked.join(plan.where("need_sql").select("query_id"), "query_id", "left_semi"), chunks, k, scope=scope)
    served = staged(best.select("query_id", "chunk_id", "doc_key", "rank", F.col("rerank_score").alias("score")).unionByName(plain.select("query_id", "chunk_id", "doc_key", "rank", F.lit(0.0).alias("score"))))
    outcomes = plan.join(served.groupBy("query_id").agg(F.count(F.lit(1)).alias("served")), "query_id", "left").select(
        "query_id", F.when(F.col("need_sql"), "sql_fallback").otherwise(F.col("mode")).alias("mode"),
        F.when(F.col("need_sql"), "sql_fallback").when(F.col("served") > 0, F.col("outcome")).otherwise("no_hits").alias("outcome"), "degraded", F.coalesce("served", F.lit(0)).alias("served"),
    )
    return served, outcomes.unionByName(queries.where(blank).select("query_id", F.lit("empty").alias("mode"), F.lit("no_hits").alias("outcome"), F.lit(False).alias("degraded"), F.lit(0).cast("long").alias("served")))


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, candidates: int = 20, weight: float = 1.0) -> DataFrame:
    """The hits of ``search`` while both channels work."""
    return search(queries, chunks, vectors, query_vectors, k, candidates, weight)[0]


def citation_line() -> Column:
    """Section, else title, with page and origin (source path, else document)."""
    part = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    head = F.coalesce(part("title_path"), part("title"), F.lit("(untitled)"))
    page = F.when(F.coalesce("page", F.lit(0)) > 0, F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise("")
    origin = F.coalesce(part("source_path"), part("doc_key"))
    return F.concat(head, page, F.when(origin.isNotNull(), F.concat(F.lit(" — "), origin)).otherwise(""))


def citation_lines(hits: DataFrame) -> DataFrame:
    """Per query: the citation lines and the machine-readable payload, in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", citation_line().alias("line"), "chunk_id", "score")))
    return hits.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("citations"), F.to_json(F.transform("r", lambda x: F.struct(x["rank"].alias("rank"), x["chunk_id"].alias("chunk_id")))).alias("payload"))


def rebuild_index(chunks: DataFrame, embed=None) -> tuple[DataFrame, DataFrame]:
    """(vectors, summary by user: chunks, indexed) from the chunk table alone; ``embed`` maps chunks to (chunk_id, embedding)."""
    vectors = chunks.select("chunk_id", "user_id").join(embed(chunks) if embed else hashed_embedding(chunks, "chunk_id"), "chunk_id")
    had = chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"))
    got = vectors.groupBy("user_id").agg(F.count(F.lit(1)).alias("indexed"))
    return vectors, had.join(got, "user_id", "left").fillna(0, ["indexed"])
