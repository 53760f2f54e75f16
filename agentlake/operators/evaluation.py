"""Retrieval evaluation: golden sets, metrics, slices, comparisons, channel analysis, index checks.

Golden rows have case_id, chunk_key; ranked rows case_id, chunk_key, rank (distinct keys per case); scores one row per
config, case and k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from agentlake.functions import text as tx
from agentlake.operators import governance, retrieval, tiles
from agentlake.operators.substrings import containing
from agentlake.sources.staging import staged

KS = (1, 3, 5)
MAX_GOLD = 5
CATEGORIES = ("happy_path", "edge_case", "adversarial")


def locate_excerpts(excerpts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, chunk_id) where the chunk's text holds the excerpt, white space aside.

    The containment test runs on few pairs, found by equal keys.  An excerpt of three tokens or more meets the chunks that
    have its rarest inner token (the two outer ones may be cut in the text); others go by the index of three-character strings.
    """
    e = excerpts.select("case_id", tx.squeezed(F.col("excerpt")).alias("needle")).where("needle <> ''").withColumn("t", F.regexp_extract_all(F.lower("needle"), F.lit(tx.TOKEN), F.lit(0)))
    inner = e.select("case_id", "needle", F.array_distinct(F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0)))).alias("inner"))
    wanted = inner.select("case_id", F.explode("inner").alias("term"))
    hay = chunks.select("chunk_id", tx.squeezed(F.col("text")).alias("hay"))
    terms = hay.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("hay"), F.lit(tx.TOKEN), F.lit(0)))).alias("term"))
    present = staged(terms.join(wanted.select("term").distinct(), "term", "left_semi"))
    counts = present.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = wanted.join(counts, "term", "left").groupBy("case_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    long = rarest.join(present, "term").select("case_id", "chunk_id").join(e.select("case_id", "needle"), "case_id").join(hay, "chunk_id").where(F.contains("hay", "needle")).select("case_id", "chunk_id")
    short = inner.where(F.size("inner") == 0).select("case_id", "needle")
    if short.isEmpty():
        return long.distinct()
    return long.unionByName(containing(short, hay.withColumnRenamed("hay", "text"), "case_id", "chunk_id")).distinct()


def rebind(golden: DataFrame, matches: DataFrame) -> DataFrame:
    """Outcome and new keys of each case from (case_id, doc_key, seq) matches of its excerpts.

    golden has case_id, keys, has_excerpt.  Cases without excerpt keep their keys; no match, matches in several documents
    and more than MAX_GOLD chunks drop the case.
    """
    found = matches.groupBy("case_id").agg(F.countDistinct("doc_key").alias("docs"), F.array_sort(F.collect_set(tx.chunk_key(F.col("doc_key"), F.col("seq")))).alias("found"))
    joined = golden.join(found, "case_id", "left")
    outcome = (
        F.when(~F.col("has_excerpt"), "no_excerpt").when(F.col("found").isNull(), "unresolved").when(F.col("docs") > 1, "ambiguous")
        .when(F.size("found") > MAX_GOLD, "template_repeat").when(F.col("found") == F.array_sort("keys"), "unchanged").otherwise("rebound")
    )
    keys = F.when(F.col("outcome") == "no_excerpt", F.col("keys")).when(F.col("outcome").isin("unchanged", "rebound"), F.col("found"))
    return joined.withColumn("outcome", outcome).withColumn("new_keys", keys).select("case_id", "outcome", "new_keys")


def expand_gold(golden: DataFrame, matches: DataFrame, limit: int = MAX_GOLD) -> DataFrame:
    """Cases with the other chunks of their own document that hold the excerpt; more than ``limit`` of them change nothing.

    golden has case_id, doc_key, keys; matches case_id, doc_key, seq.
    """
    same = matches.join(golden.select("case_id", "doc_key"), ["case_id", "doc_key"]).groupBy("case_id").agg(F.collect_set(tx.chunk_key(F.col("doc_key"), F.col("seq"))).alias("more"))
    both = F.array_sort(F.array_union("keys", F.coalesce("more", F.array().cast("array<string>"))))
    return golden.join(same, "case_id", "left").withColumn("keys", F.when(F.size(both) <= limit, both).otherwise(F.array_sort("keys"))).drop("more")


def evaluate(golden: DataFrame, cases: DataFrame, configs: dict[str, DataFrame], ks: tuple[int, ...] = KS, sizes: DataFrame | None = None) -> DataFrame:
    """Scores of several configurations (name -> ranked hits) over one golden set; ``cases`` gives category, tags and error; ``sizes`` as in ``score_cases``."""
    out = None
    for name, ranked in configs.items():
        one = score_cases(ranked, golden, ks, sizes).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.join(cases.select("case_id", "category", "tags", "error"), "case_id")


def score_cases(ranked: DataFrame, golden: DataFrame, ks: tuple[int, ...] = KS, sizes: DataFrame | None = None) -> DataFrame:
    """case_id, k, hit, recall, rr; an empty gold set scores 0.

    With ``sizes`` (case_id, n_gold) the gold rows are not counted, so ``golden`` may do without those that no ranking has.
    """
    gold = sizes if sizes is not None else golden.groupBy("case_id").agg(F.count("chunk_key").alias("n_gold"))
    hits = ranked.join(golden.where("chunk_key is not null").distinct(), ["case_id", "chunk_key"]).groupBy("case_id").agg(F.collect_list("rank").alias("ranks"), F.min("rank").alias("first"))
    joined = gold.join(hits, "case_id", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.size(F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: r <= F.col("k")))
    recall = F.when(F.col("n_gold") > 0, inside / F.col("n_gold")).otherwise(0.0)
    return joined.select("case_id", "k", (inside > 0).alias("hit"), F.round(recall, 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def _means(scores: DataFrame, *by: str) -> DataFrame:
    ok = F.col("error").isNull()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0)), 6)
    return scores.groupBy(*by, "k").agg(mean(F.col("hit").cast("double")).alias("hit"), mean(F.col("recall")).alias("recall"), mean(F.col("rr")).alias("mrr"), F.count_if(~ok).alias("failed"))


def eval_report(scores: DataFrame) -> DataFrame:
    """Means by config and k; cases with an error only count in ``failed``."""
    return _means(scores, "config")


def eval_by_category(scores: DataFrame) -> DataFrame:
    return _means(scores, "config", "category")


def eval_by_tag(scores: DataFrame) -> DataFrame:
    return _means(scores.withColumn("tag", F.explode("tags")), "config", "tag")


def case_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """gained, lost or same by reciprocal rank; cases of one side only are left out."""
    joined = a.select("case_id", F.col("rr").alias("rr_a")).distinct().join(b.select("case_id", F.col("rr").alias("rr_b")).distinct(), "case_id")
    return joined.withColumn("change", F.when(F.col("rr_b") > F.col("rr_a"), "gained").when(F.col("rr_b") < F.col("rr_a"), "lost").otherwise("same"))


def ab_table(report: DataFrame) -> DataFrame:
    """One row per config and k; every best value is marked, ties all."""
    w = Window.partitionBy("k")
    return report.select("config", "k", *(c for m in ("hit", "recall", "mrr") for c in (F.col(m), (F.col(m) == F.max(m).over(w)).alias(f"best_{m}"))))


def best_config(report: DataFrame, ablations: tuple[str, ...] = ()) -> DataFrame:
    """The config of the best (hit@5, mrr), ablations aside."""
    at5 = report.where((F.col("k") == 5) & ~F.col("config").isin(*ablations)) if ablations else report.where("k = 5")
    return at5.agg(F.max_by("config", F.struct("hit", "mrr", "config")).alias("config"))


def eval_gate(report: DataFrame, hit: float, recall: float) -> DataFrame:
    failing = (F.col("failed") > 0) | (F.col("hit") < hit) | (F.col("recall") < recall)
    return report.where("k = 5").select("config", F.when(failing, "fail").otherwise("pass").alias("verdict"))


def dose_response(reports: DataFrame) -> DataFrame:
    """weight, metric and its step; monotone if no step goes down."""
    order = Window.orderBy("weight")
    stepped = reports.withColumn("step", F.round(F.col("metric") - F.lag("metric").over(order), 6))
    return stepped.withColumn("monotone", F.coalesce(F.bool_and(F.col("step") >= 0).over(Window.partitionBy()), F.lit(True)))


def channel_probe(golden: DataFrame, vector: DataFrame, lexical: DataFrame, fused: DataFrame) -> DataFrame:
    """Per case: the gold's rank in each channel and after fusion, its lexical score and the channel's best."""
    gold = golden.where("chunk_key is not null").distinct()
    first = lambda hits, name: gold.join(hits, ["case_id", "chunk_key"]).groupBy("case_id").agg(F.min("rank").alias(name))
    best = lexical.groupBy("case_id").agg(F.max("score").alias("lex_top"))
    score = gold.join(lexical, ["case_id", "chunk_key"]).groupBy("case_id").agg(F.max("score").alias("lex_score"))
    out = gold.select("case_id").distinct()
    for part in (first(vector, "vec_rank"), first(lexical, "lex_rank"), first(fused, "fused_rank"), best, score):
        out = out.join(part, "case_id", "left")
    return out.withColumn("lex_ratio", F.round(F.col("lex_score") / F.col("lex_top"), 6))


def channel_summary(probes: DataFrame) -> DataFrame:
    v, x = F.col("vec_rank").isNotNull(), F.col("lex_rank").isNotNull()
    return probes.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v & x).alias("both"), F.count_if(v & ~x).alias("vector_only"), F.count_if(x & ~v).alias("lexical_only"), F.count_if(~v & ~x).alias("neither"),
        F.count_if(F.col("lex_rank") > 1).alias("junk_above_gold"), F.count_if((F.col("lex_ratio") > 0) & (F.col("lex_ratio") <= 0.35)).alias("low_confidence"),
    )


def fusion_mechanism(probes: DataFrame) -> DataFrame:
    both = probes.where("vec_rank is not null and lex_rank is not null")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("fused_rank > vec_rank")).alias("dragged"), F.count_if(F.expr("fused_rank < vec_rank")).alias("lifted"), F.count_if(F.expr("fused_rank = vec_rank")).alias("flat"),
        F.count_if(F.expr("lex_rank > vec_rank")).alias("lexical_worse"), mean("vec_rank"), mean("lex_rank"), mean("fused_rank"),
    )


def length_penalty(lengths: DataFrame) -> DataFrame:
    """n, mean length and the BM25 length factor of each group against the whole; the whole follows from the groups' sums."""
    own = lengths.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    groups = Window.partitionBy()
    mean = F.col("total") / F.col("n")
    return own.withColumn("all", F.sum("total").over(groups) / F.sum("n").over(groups)).select("grp", "n", F.round(mean, 6).alias("mean_length"), F.round(0.25 + 0.75 * mean / F.col("all"), 6).alias("penalty"))


def threshold_sweep(pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Labelled pairs (score, duplicate): caught, missed and false hits at each threshold."""
    t = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    over = F.col("score") >= F.col("threshold")
    return t.groupBy("threshold").agg(F.count_if(over & F.col("duplicate")).alias("caught"), F.count_if(~over & F.col("duplicate")).alias("missed"), F.count_if(over & ~F.col("duplicate")).alias("false_hits"))


def labelled_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """duplicate, score, n: how many pairs of a query and a vector of its user with a greater id have each rounded cosine; a duplicate has its label.

    Rows have id, user_id, label and embedding.  Each tile adds up its own pairs, so only different scores leave a task.
    """
    side = lambda rows: rows.select("id", "user_id", "label", F.col("embedding").alias("load"))

    def counted(user_id, left, right, alone):
        if not len(left) or not len(right):
            return
        # A cosine of six digits is a place among these; behind them stand those that are no number.
        edge, asks, ids = 1_000_002, left["id"].to_numpy(), right["id"].to_numpy()
        width = 2 * edge + 2
        codes = pc.dictionary_encode(pa.chunked_array([*left["label"].chunks, *right["label"].chunks])).combine_chunks()
        codes = (pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        own, other = codes[: len(asks)], codes[len(asks) :]
        total, waiting = np.zeros(3 * width, np.int64), []
        for first, score in tiles.cosines(left["load"], right["load"]):
            a, later = own[first : first + len(score), None], ids[None, :] > asks[first : first + len(score), None]
            odd = np.isnan(score)
            place = tiles.rounded(np.where(odd, 0, score)) * 1e6
            place[odd] = edge + 1
            kind = np.where((a < 0) | (other < 0), 2, a == other)
            waiting.append((np.rint(place).astype(np.int32) + edge + kind.astype(np.int32) * width)[later])
            if sum(map(len, waiting)) >= 16 * tiles.CELLS:
                total += np.bincount(np.concatenate(waiting), minlength=len(total))
                waiting = []
        total += np.bincount(np.concatenate([*waiting, np.zeros(0, np.int32)]), minlength=len(total))
        found = np.nonzero(total)[0]
        kind, place = found // width, found % width
        score = np.where(place > 2 * edge, np.nan, (place - edge) / 1e6)
        yield tiles.batch(duplicate=pa.array(kind == 1, mask=kind == 2), score=score, n=total[found])

    found = tiles.pairs(side(queries), side(vectors), counted, "duplicate boolean, score double, n long")
    return found.groupBy("duplicate", "score").agg(F.sum("n").alias("n"))


def score_spread(pairs: DataFrame) -> DataFrame:
    """duplicate, min, median (the upper one) and max of the scores of labelled pairs; a row may stand for ``n`` pairs."""
    counted = staged(pairs.groupBy("duplicate", "score").agg((F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))).alias("n")))
    middle = governance.rank_percentiles(counted, "score", "duplicate", (0.5,), count="n").select("duplicate", F.col("value").alias("median"))
    return counted.groupBy("duplicate").agg(F.min("score").alias("min"), F.max("score").alias("max")).join(middle, "duplicate")


def sample_evenly(rows: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """Up to ``cap`` rows of each group, evenly spaced with both ends; places round half to even."""
    w = Window.partitionBy(by)
    placed = rows.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    if cap == 1:
        return placed.where("at = 0").drop("at", "n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (cap - 1)).cast("int"))
    return placed.where((F.col("n") <= cap) | F.array_contains(wanted, F.col("at"))).drop("at", "n")


def golden_profile(golden: DataFrame) -> DataFrame:
    """Cases, cases of several keys and the most keys, by category."""
    n = F.size("keys")
    return golden.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.count_if(n > 1).alias("multi_gold"), F.max(n).alias("max_gold"))


def golden_by_document(golden: DataFrame) -> DataFrame:
    """doc_key, cases that have one of its chunks as gold."""
    return golden.select("case_id", F.explode("keys").alias("key")).groupBy(F.substring_index("key", "#", 1).alias("doc_key")).agg(F.countDistinct("case_id").alias("cases"))


def pruned_golden(golden: DataFrame, limit: int = MAX_GOLD) -> DataFrame:
    """Which cases stay; more keys than the limit are a template, not an answer."""
    return golden.withColumn("kept", F.size("keys") <= limit)


def validate_golden(cases: DataFrame) -> DataFrame:
    """The first broken rule of each case: unknown category, no keys, an id met before."""
    again = F.count(F.lit(1)).over(Window.partitionBy("case_id")) > 1
    reason = F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category").when(F.coalesce(F.size("keys"), F.lit(0)) == 0, "no gold").when(again, "repeated id")
    return cases.withColumn("reason", reason)


MEASURED, TAGGED, OVERLAPPING = 6, 10, 0.85


def longest_shared(pairs: DataFrame, key: str, a: str, b: str, least: int = MEASURED) -> DataFrame:
    """key, shared: length of the longest string that two texts of a row share, white space aside; rows that share none of ``least`` are left out.

    Strings of ``least`` characters that both have meet by equality, with their places.  Where the difference of the two places stays the
    same from one to the next, they lie in one longer string: runs on such diagonals are measured, and the longest counts.
    The key may have any name; inside it is ``key``, so that it meets none of the columns made here.
    """
    grams = lambda c, at: pairs.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(tx.squeezed(F.col(c)), F.lit(f"(?s)(?=(.{{{least}}}))"), F.lit(1))).alias(at, "gram"))
    met = grams(a, "i").join(grams(b, "j"), ["key", "gram"]).select("key", "i", (F.col("i") - F.col("j")).alias("diagonal"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("key", "diagonal").orderBy("i"))
    lengths = met.withColumn("run", run).groupBy("key", "diagonal", "run").agg((F.count(F.lit(1)) + (least - 1)).cast("int").alias("length"))
    return lengths.groupBy(F.col("key").alias(key)).agg(F.max("length").alias("shared"))


def validate_candidates(cases: DataFrame) -> DataFrame:
    """case_id, reason (null: accepted), shared, leak: rules for question and excerpt against the chunk's indexed text.

    ``shared`` is the longest string that question and text have in common, 0 below ``MEASURED``; it is measured on accepted cases
    only.  Rows have a case_id each.
    """
    q, x, text = tx.squeezed(F.col("question")), tx.squeezed(F.col("excerpt")), tx.squeezed(F.col("indexed"))
    bare = F.regexp_replace(F.coalesce("question", F.lit("")), r"(?U)^\s+|\s+$", "")
    reason = (
        F.when(F.length(bare) < 6, "question too short").when(x == "", "no excerpt").when(~F.contains(text, x), "not verbatim")
        .when(F.length(x) < 8, "excerpt too short").when(F.contains(text, q), "question copied")
    )
    terms = lambda c: F.array_distinct(tx.tokens(F.col(c)))
    overlap = F.size(F.array_intersect(terms("question"), terms("indexed"))) / F.greatest(F.size(terms("question")), F.lit(1))
    told = staged(cases.select("case_id", "question", "indexed", reason.alias("reason"), overlap.alias("overlap")))
    spans = longest_shared(told.where("reason is null"), "case_id", "question", "indexed")
    measured = told.select("case_id", "reason", "overlap").join(spans, "case_id", "left").withColumn("shared", F.when(F.col("reason").isNull(), F.coalesce("shared", F.lit(0))))
    return measured.select("case_id", "reason", "shared", (F.col("reason").isNull() & ((F.col("shared") >= TAGGED) | (F.col("overlap") >= OVERLAPPING))).alias("leak"))


def contamination(docs: DataFrame, passages: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, item_id, shared, coverage: word n-grams that a document shares with a passage, by the passage's own."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return words.select(key, F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))).alias("g"))

    asked = grams(passages, "item_id")
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"))
    shared = grams(docs, "doc_id").join(asked, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("grams"), 6).alias("coverage"))


def index_check(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """query_id, kind, cosine of sampled chunks (query_id, user_id, embedding), each searched among the stored vectors of its user.

    self: it finds itself first; other: another one; none: its user has no vectors at all, or its own is missing.
    """
    stored = staged(stored)
    first = retrieval.vector_topk(samples, stored, 1).select("query_id", "chunk_id", "score")
    own = stored.select(F.col("chunk_id").alias("query_id"), F.lit(True).alias("stored")).distinct()
    told = samples.select("query_id").join(first, "query_id", "left").join(own, "query_id", "left")
    kind = F.when(F.col("chunk_id").isNull() | F.col("stored").isNull(), "none").when(F.col("chunk_id") == F.col("query_id"), "self").otherwise("other")
    return told.select("query_id", kind.alias("kind"), F.when(kind == "none", 0.0).otherwise(F.col("score")).alias("cosine"))


def drift_verdict(samples: DataFrame) -> DataFrame:
    """empty, partial, match, drift or severe from (cosine, found) of sampled chunks against their stored vectors."""
    n, missing, mean = F.count(F.lit(1)), F.count_if(~F.col("found")), F.avg("cosine")
    told = F.when(n == 0, "no chunks").when(missing == n, "empty").when(missing > 0, "partial").when(mean >= 0.98, "match").when(mean < 0.5, "severe").otherwise("drift")
    return samples.agg(told.alias("verdict"), n.alias("n"), missing.alias("missing"))
