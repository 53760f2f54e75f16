"""Indexes that skip work, against doing all of it."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.operators import governance as g, memory as m, pivots as pv, retrieval as r
from agentlake.operators.substrings import containing


def test_strings_are_found_wherever_they_are(spark):
    rng = random.Random(4)
    signs = "ab c%_\\é中😀\n"
    texts = [(i, i % 3, "".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 2, 3, 40, 200))))) for i in range(60)] + [(99, 0, None), (98, 1, "a" * 5000)]
    needles = [(i, i % 3, "".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 6))))) for i in range(120)] + [(500, 1, "a" * 70), (501, 1, "a" * 64 + "b"), (502, 0, None)]
    hay, asked = spark.createDataFrame(texts, "chunk_id long, user_id long, text string"), spark.createDataFrame(needles, "query_id long, user_id long, needle string")
    got = sorted(map(tuple, containing(asked, hay, "query_id", "chunk_id", ("user_id",)).collect()))
    assert got == sorted((q, c) for q, u, n in needles for c, v, t in texts if n and t and u == v and n in t)
    assert len(got) > 100
    everywhere = sorted(map(tuple, containing(asked.drop("user_id"), hay.drop("user_id"), "query_id", "chunk_id").collect()))
    assert everywhere == sorted((q, c) for q, _, n in needles for c, _, t in texts if n and t and n in t)
    plan = containing(asked, hay, "query_id", "chunk_id", ("user_id",))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fallback_sees_what_is_embedded(spark):
    chunks = spark.createDataFrame([(1, 7, "d", 0, "Guide > Setup", "Install it."), (2, 7, "d", 1, "", "guide the rest"), (3, 8, "e", 0, "Guide", "x")], "chunk_id long, user_id long, doc_key string, seq int, title_path string, text string")
    ask = lambda text, scope=None: [x["chunk_id"] for x in r.substring_search(spark.createDataFrame([(1, 7, text)], "query_id long, user_id long, text string"), chunks, scope=scope).orderBy("rank").collect()]
    assert ask("  GUIDE ") == [1, 2] and ask("setup\n\ninstall") == [1] and ask("setup\ninstall") == [] and ask("%") == [] and ask(">") == [1]
    assert ask("guide", spark.createDataFrame([(1, "other")], "query_id long, doc_key string")) == []


def test_scopes_come_before_the_first_hits(spark):
    """Forty chunks match and the scope names two documents: whatever channel serves, both are found."""
    chunks = spark.createDataFrame([(k, 1, f"doc-{k}", 0, "", f"apple number{k} " + "apple " * (40 - k)) for k in range(40)], "chunk_id long, user_id long, doc_key string, seq int, title_path string, text string")
    queries = spark.createDataFrame([(q, 1, "apple") for q in range(4)], "query_id long, user_id long, text string")
    vectors = chunks.select("chunk_id", "user_id", F.array(F.lit(1.0), F.col("chunk_id") * 0.01).alias("embedding"))
    asked = queries.select("query_id", "user_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    health = spark.createDataFrame([(0, "ok", True), (1, "down", True), (2, "ok", False), (3, "down", False)], "query_id long, vector_state string, lexical_ok boolean")
    scope = spark.createDataFrame([(q, f"doc-{k}") for q in range(4) for k in (38, 39)], "query_id long, doc_key string")
    for index in (None, r.lexical_index(chunks)):
        hits, outcomes = r.search(queries, chunks, vectors, asked, health=health, scope=scope, index=index)
        found = hits.collect()
        assert {q: sorted(x["chunk_id"] for x in found if x["query_id"] == q) for q in range(4)} == {q: [38, 39] for q in range(4)}
        assert {x["query_id"]: (x["outcome"], x["served"]) for x in outcomes.collect()} == {0: ("hybrid_ok", 2), 1: ("bm25_fallback", 2), 2: ("vector_only", 2), 3: ("sql_fallback", 2)}


def overlap_by_hand(queries, rows, k, older):
    out = []
    for q, user, terms in queries:
        scored = sorted(((len(set(terms) & set(t)), i) for i, u, t in rows if u == user and set(terms) & set(t) and (not older or i < q)), reverse=True)
        out += [(q, i, n, place) for place, (n, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("older", [False, True])
def test_best_overlaps_with_a_term_in_all_rows(spark, older):
    rng = random.Random(9)
    word = lambda: f"t{int(rng.random() ** 3 * 60)}"
    rows = [(i, i % 2, sorted({"all", *(word() for _ in range(rng.randrange(1, 9)))})) for i in range(400)]
    queries = [(i, i % 2, sorted({"all", "never", *(word() for _ in range(rng.randrange(0, 7)))})) for i in range(100, 160)] + [(200, 0, ["all"]), (201, 1, ["never"]), (202, 1, [])]
    left = spark.createDataFrame(queries, "query_id long, user_id long, terms array<string>")
    right = spark.createDataFrame(rows, "id long, user_id long, terms array<string>")
    for k in (1, 3, 12):
        got = sorted((x["query_id"], x["id"], x["shared"], x["rank"]) for x in m.overlap_topk(left, right, k, older).collect())
        assert got == overlap_by_hand(queries, rows, k, older)


def test_stored_weights_give_the_same_hits_and_skip_blocks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda topic: " ".join(rng.choice(words[topic * 30 : topic * 30 + 30]) if rng.random() < 0.8 else rng.choice(words) for _ in range(30))
    chunks = spark.createDataFrame([(i, i % 2, f"d{i}", text(i // 100)) for i in range(1000)] + [(2000, 0, "e", ""), (2001, 0, "e", None)], "chunk_id long, user_id long, doc_key string, text string")
    queries = spark.createDataFrame([(q, q % 2, text(q % 10)) for q in range(30)] + [(90, 0, "nowhere at all"), (91, 5, "w1")], "query_id long, user_id long, text string")
    weighed, blocks = r.weighted_index(r.lexical_index(chunks))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    for k in (1, 5, 600):
        hits, told = r.pruned_topk(queries, weighed, blocks, k)
        assert rows(hits) == rows(r.bm25_topk(queries, chunks, k))
        done, every = told.agg(F.sum("scored"), F.sum("blocks")).first()
        assert done < every if k == 1 else done <= every


@pytest.mark.parametrize("per", [0.3, 2.0])
def test_pivots_give_the_same_neighbours_and_skip_groups(spark, per):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    made = [(int(i), 0, (centers[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(900)]
    made += [(int(1000 + i), 1, rng.normal(size=16).tolist()) for i in range(150)] + [(3000, 0, [0.0] * 16), (3001, 0, [1.0, 2.0]), (3002, 2, [0.0, 0.0]), (3003, 2, [1.0, 0.0]), (3004, 2, [-1.0, 0.0])]
    made += [(int(4000 + i), 0, made[5][2]) for i in range(40)]
    vectors = spark.createDataFrame(made, "chunk_id long, user_id long, embedding array<double>")
    asked = [(q, u, v) for q, u, v in made[::90]] + [(5000, 0, [0.0] * 16), (5001, 2, [1.0, 0.1]), (5002, 9, [1.0, 1.0]), (5003, 1, rng.normal(size=16).tolist()), (5004, 0, [3.0, 1.0])]
    queries = spark.createDataFrame(asked, "query_id long, user_id long, embedding array<double>")
    members, pivots = pv.pivot_index(vectors, per)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    for k in (1, 10, 60):
        hits, told = pv.pivot_topk(queries, vectors, members, pivots, k)
        assert rows(hits) == rows(r.vector_topk(queries, vectors, k))
    if per == 2.0:
        done, every = pv.pivot_topk(queries, vectors, members, pivots, 1)[1].where("query_id < 900").agg(F.sum("scored"), F.sum("groups")).first()
        assert done < 0.5 * every


def test_hashed_vectors_equal_a_plain_sum(spark):
    token = re.compile(r"[a-z0-9_]+|[一-鿿]")
    texts = [(1, "One two two THREE"), (2, "中文 a字"), (3, ""), (4, None), (5, " ".join(f"w{i % 97}" for i in range(3000))), (6, "...")]
    want = {}
    for i, t in texts:
        toks = token.findall((t or "").lower())
        toks = toks + [a + b for a, b in zip(toks, toks[1:]) if len(a) == 1 and a > "一"]
        v = [0.0] * 64
        for x in toks:
            h = hashlib.md5(x.encode()).digest()
            v[int.from_bytes(h[:4], "big") % 64] += 1 if h[4] % 2 == 0 else -1
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        if toks:
            want[i] = [x / n for x in v]
    got = {x["i"]: x["embedding"] for x in r.hashed_embedding(spark.createDataFrame(texts, "i int, text string"), "i").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    assert "Exchange" not in r.hashed_embedding(spark.createDataFrame(texts, "i int, text string"), "i")._jdf.queryExecution().executedPlan().toString()


def windows_by_hand(rows, width, limit):
    out, state = {}, {}
    for user, us, event in sorted(rows):
        start, n = state.get(user, (None, 0))
        if start is None or us - start >= width:
            start, n = us, 0
        state[user] = (start, n + 1)
        out[event] = (user, start, n + 1, n + 1 <= limit)
    return out


@pytest.mark.parametrize("fold", [4, 256])
def test_windows_of_islands(spark, fold):
    rng = random.Random(7)
    rows, us = [], 0
    for k in range(3000):
        us += rng.choice((0, 1, 500_000, 3_000_000, 59_999_999, 60_000_000, 61_000_000)) if rng.random() < 0.3 else rng.randrange(2_000_000)
        rows.append((k % 3 if k < 2000 else 7, us, k))
    rows += [(8, 120_000_000 * k, 10_000 + k) for k in range(5)] + [(9, -5, 20_000), (9, 59_999_995, 20_001), (9, 59_999_994, 20_002), (None, 1, 30_000)]
    events = spark.createDataFrame(rows, "user_id long, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    got = {x["event_id"]: (x["user_id"], x["start"], x["place"], x["allowed"]) for x in g.rate_windows(events, 60.0, 20, fold).collect()}
    known = [x for x in rows if x[0] is not None]
    assert {k: v for k, v in got.items() if v[0] is not None} == windows_by_hand(known, 60_000_000, 20)


def test_one_user_of_very_many_events(spark):
    """Two million events of one user, one a second with jitter: starts are a window apart at least and cover all."""
    events = spark.range(2_000_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(900_000))).alias("ts"))
    got = g.rate_windows(events).withColumn("us", F.unix_micros(F.timestamp_micros(F.col("event_id") * 1_000_000 + F.pmod(F.xxhash64("event_id"), F.lit(900_000)))))
    n, low, high, starts, places = got.agg(F.count(F.lit(1)), F.min(F.col("us") - F.col("start")), F.max(F.col("us") - F.col("start")), F.countDistinct("start"), F.max("place")).first()
    assert n == 2_000_000 and low == 0 and high < 60_000_000 and 2_000_000 / 61 < starts <= 2_000_000 / 60 + 1 and places in (60, 61)
