"""Hand-made rows for operators whose order or rules SQL can't show, and batch against stream."""

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from agentlake.functions import text as tx
from agentlake.operators import chunks as ch, corpus as c, evaluation as ev, flywheel as fw, governance as g, memory as m, retrieval as r, tables as tb, trajectory as t
from agentlake.sources import buckets, tables as src
from agentlake.streaming import jobs


def hits(spark, lists):
    return [(spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, chunk_id long, rank int"), 1.0) for ids in lists]


def test_fusion(spark):
    fused = {x["chunk_id"]: x["score"] for x in r.rrf(hits(spark, [(10, 20, 30), (20, 30, 10)])).collect()}
    assert fused == {10: round(1 / 61 + 1 / 63, 9), 20: round(1 / 61 + 1 / 62, 9), 30: round(1 / 62 + 1 / 63, 9)}
    ties = r.rrf(hits(spark, [(7,), (3,), (5,)])).orderBy("rank").collect()
    assert [x["chunk_id"] for x in ties] == [3, 5, 7]
    with pytest.raises(ValueError):
        r.rrf(hits(spark, [(1,)]), k=0)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("xaybz")] + [(2, "g1", 1)], "case_id long, chunk_key string, rank int")
    golden = spark.createDataFrame([(1, "a"), (1, "b"), (3, None)] + [(2, f"g{i}") for i in range(54)], "case_id long, chunk_key string")
    got = {(x["case_id"], x["k"]): (x["hit"], x["recall"], x["rr"]) for x in ev.score_cases(ranked, golden).collect()}
    assert [got[(1, k)][1] for k in (1, 3, 5)] == [0.0, 0.5, 1.0] and got[(1, 5)][2] == 0.5
    assert got[(2, 5)] == (True, round(1 / 54, 6), 1.0) and got[(3, 5)] == (False, 0.0, 0.0)


def test_rebind(spark):
    golden = spark.createDataFrame([(1, ["d#1"], True), (2, ["d#1"], True), (3, ["d#9"], True), (4, ["d#0"], True), (5, ["d#3"], False), (6, ["d#0"], True)], "case_id long, keys array<string>, has_excerpt boolean")
    found = [(1, "d", 2), (2, "d", 1), (4, "d", 0), (4, "e", 0)] + [(6, "d", i) for i in range(6)]
    got = {x["case_id"]: (x["outcome"], x["new_keys"]) for x in ev.rebind(golden, spark.createDataFrame(found, "case_id long, doc_key string, seq int")).collect()}
    assert got == {1: ("rebound", ["d#2"]), 2: ("unchanged", ["d#1"]), 3: ("unresolved", None), 4: ("ambiguous", None), 5: ("no_excerpt", ["d#3"]), 6: ("template_repeat", None)}


def test_excerpts_without_inner_token_still_match(spark):
    chunks = spark.createDataFrame([(1, "ab cd"), (2, "x  abc d y"), (3, "one two\nthree four")], "chunk_id long, text string")
    cases = spark.createDataFrame([(1, "b c"), (2, "abc d"), (3, "wo two three f".replace("wo two", "two")), (4, "TWO three four"), (5, " ")], "case_id long, excerpt string")
    got = {(x["case_id"], x["chunk_id"]) for x in ev.locate_excerpts(cases, chunks).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (3, 3)} - {(1, 2)}


def test_excerpts_of_few_tokens_or_none_match_as_a_plain_search(spark):
    rng = random.Random(3)
    signs = ["ab", "abc", "b", "中", "文", " ", "  ", "--", "…", "x_1", "\n", ".", "é"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    needles = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    squeeze = lambda t: re.sub(r"\s+", " ", t).strip(" ")
    want = {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if squeeze(n) and squeeze(n) in squeeze(t)}
    got = ev.locate_excerpts(spark.createDataFrame([*enumerate(needles)], "case_id int, excerpt string"), spark.createDataFrame([*enumerate(texts)], "chunk_id int, text string"))
    assert len(want) > 50 and {tuple(x) for x in got.collect()} == want


def test_longest_shared_string(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ab c") for _ in range(rng.randint(0, 25))), "".join(rng.choice("ab c") for _ in range(rng.randint(0, 25)))) for _ in range(80)]
    squeeze = lambda t: re.sub(r"\s+", " ", t).strip(" ")
    rows += [(None, "abcdefgh"), ("xx" * 400 + "needle in hay", "yy" * 900 + "a needle  in\thay!"), ("aaaaaaaaaa", "aaaaaaaa")]
    keyed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = {r["i"]: r["shared"] for r in ev.longest_shared(keyed, "i", "a", "b").collect()}
    for i, (a, b) in enumerate(rows):
        sa, sb = squeeze(a or ""), squeeze(b or "")
        best = max((n for n in range(len(sa) + 1) for k in range(len(sa) - n + 1) if sa[k : k + n] in sb), default=0) if len(sa) < 100 else len("needle in hay")
        assert got.get(i, 0) == (best if best >= 6 else 0), (a, b)


@pytest.mark.parametrize("key", ["i", "j", "gram", "diagonal", "run", "length", "key"])
def test_longest_shared_string_takes_a_key_of_any_name(spark, key):
    pairs = spark.createDataFrame([(1, "one needle here", "a needle  there"), (2, "abc", "abc"), (3, "two needles", "two needles")], f"{key} int, a string, b string")
    assert {tuple(r) for r in ev.longest_shared(pairs, key, "a", "b").select(key, "shared").collect()} == {(1, len(" needle ")), (3, len("two needles"))}


def test_index_check_tells_self_other_and_none(spark):
    stored = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (4, 1, [0.0, 1.0])], "chunk_id long, user_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 1, [1.0, 0.0]), (9, 7, [1.0, 0.0])], "query_id long, user_id long, embedding array<double>")
    got = {x["query_id"]: (x["kind"], x["cosine"]) for x in ev.index_check(asked, stored).collect()}
    assert got == {1: ("self", 1.0), 2: ("other", 0.8), 3: ("none", 0.0), 9: ("none", 0.0)}
    assert ev.drift_verdict(ev.index_check(asked, stored).select((F.col("kind") != "none").alias("found"), "cosine")).first()["verdict"] == "partial"


def test_percentiles_equal_a_sorted_list(spark):
    rng = random.Random(6)
    rows = [("a", rng.random() ** 5) for _ in range(900)] + [("b", float(rng.randint(0, 3))) for _ in range(300)] + [("c", 1.5), ("d", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)
    want = {(k, p): sorted(x)[min(len(x) - 1, int(len(x) * p))] for k in "abc" for x in [[v for g_, v in rows if g_ == k]] for p in shares}
    for ranges in (2, 7, 256):
        assert {(x["g"], x["p"]): x["value"] for x in g.rank_percentiles(frame, "v", "g", shares, ranges).collect()} == want
    spread = {x["duplicate"]: (x["min"], x["median"], x["max"]) for x in ev.score_spread(spark.createDataFrame([(0.1, True), (0.5, True), (0.9, True), (0.7, True), (0.2, False)], "score double, duplicate boolean")).collect()}
    assert spread == {True: (0.1, 0.7, 0.9), False: (0.2, 0.2, 0.2)}


def test_search_with_failing_channels_scopes_and_blank_queries(spark):
    chunks = spark.createDataFrame([(k, 1, f"doc-{k // 2}", k % 2, "", t) for k, t in enumerate(["red apple pie", "green apple", "blue berry", "apple tart", "nothing", "plum cake"])] + [(9, 2, "doc-9", 0, "", "apple of another")], "chunk_id long, user_id long, doc_key string, seq int, title_path string, text string")
    queries = spark.createDataFrame([(1, 1, "apple"), (2, 1, "apple"), (3, 1, "apple"), (4, 1, "plum"), (5, 1, "  "), (6, 1, "zebra"), (7, 1, None)], "query_id long, user_id long, text string")
    vectors = chunks.select("chunk_id", "user_id", F.when(F.contains("text", F.lit("apple")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    asked = queries.where("query_id <> 4").select("query_id", "user_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    health = spark.createDataFrame([(1, "ok", True), (2, "embed_failed", True), (3, "down", False), (4, "ok", False), (6, "down", True)], "query_id long, vector_state string, lexical_ok boolean")
    scope = spark.createDataFrame([(1, "doc-1")], "query_id long, doc_key string")
    for index in (None, r.lexical_index(chunks)):
        hits, outcomes = r.search(queries, chunks, vectors, asked, health=health, scope=scope, index=index)
        told = {x["query_id"]: (x["mode"], x["outcome"], x["degraded"]) for x in outcomes.collect()}
        assert told == {1: ("hybrid", "hybrid_ok", False), 2: ("bm25_fallback", "embed_failed", True), 3: ("sql_fallback", "sql_fallback", True), 4: ("sql_fallback", "sql_fallback", True), 5: ("empty", "no_hits", False), 6: ("sql_fallback", "sql_fallback", True), 7: ("empty", "no_hits", False)}
        rows = hits.collect()
        by = {q: [x["chunk_id"] for x in sorted(rows, key=lambda x: x["rank"]) if x["query_id"] == q] for q in range(1, 8)}
        assert set(by[1]) == {2, 3} and by[1][0] == 3  # only doc-1, and the other's chunk never
        assert set(by[2]) == {0, 1, 3} and by[3] == [0, 1, 3] and by[4] == [5] and not by[5] and not by[6] and not by[7]
        assert all(sorted(x["rank"] for x in rows if x["query_id"] == q) == list(range(1, len(by[q]) + 1)) for q in by)
    plain = r.search(queries.where("query_id = 6"), chunks, vectors, asked.where("query_id = 6").limit(0))
    assert plain[0].count() == 0 and [(x["mode"], x["outcome"]) for x in plain[1].collect()] == [("empty", "no_hits")]


def test_index_follows_changed_documents(spark, tmp_path):
    """A stream of changed chunks leaves the index that a rebuild gives; a batch that comes again changes nothing."""
    shape = "chunk_id long, user_id long, doc_key string, text string"
    first = spark.createDataFrame([(1, 1, "a", "one two two"), (2, 1, "b", "three"), (3, 1, "b", "four")], shape)
    changed = spark.createDataFrame([(2, 1, "b", "three three five")], shape)
    root, source = str(tmp_path / "index"), str(tmp_path / "changes")
    buckets.store(r.lexical_index(first), root, ("doc_key",))
    changed.write.parquet(source)
    stream = spark.readStream.schema(shape).parquet(source)
    for _ in range(2):
        jobs.index_stream(stream, root, str(tmp_path / "c"), None).awaitTermination()
    now = sorted(map(tuple, buckets.stored(spark, root).select("chunk_id", "term", "tf", "dl").collect()))
    assert now == sorted(map(tuple, r.lexical_index(first.where("doc_key = 'a'").unionByName(changed)).select("chunk_id", "term", "tf", "dl").collect()))


def test_versions_are_published_once(spark, tmp_path):
    root = str(tmp_path / "t")
    src.publish(spark.range(3), root, "v1")
    src.publish(spark.range(5), root, "v2")
    src.publish(spark.range(9), root, "v2")  # the same batch again
    assert spark.read.parquet(f"{root}/pointer").count() == 2 and src.published(spark, root).count() == 5


def files_by_bucket(root):
    import glob
    import os

    found = {}
    for path in glob.glob(f"{root}/rows/bucket=*/*.parquet"):
        found.setdefault(int(os.path.dirname(path).rpartition("=")[2]), set()).add(os.path.basename(path))
    return found


def test_a_change_writes_its_own_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = spark.range(500).select(F.concat(F.lit("d"), "id").alias("doc_key"), F.lit(0).alias("seq"), F.lit("old").alias("text"))
    buckets.store(rows, root, ("doc_key",))
    before = files_by_bucket(root)
    batch = spark.createDataFrame([("d1", 0, "new"), ("d2", 0, "new"), ("x", 0, "new")], rows.schema)
    calls = []

    def apply(now, changed):
        calls.append(now.count())
        return tb.replaced(now, changed, ("doc_key",))

    touched = buckets.change(batch, 7, root, "w", ("doc_key",), apply)
    after = files_by_bucket(root)
    assert {b for b in after if after[b] != before.get(b)} == set(touched) and len(touched) <= 3
    assert calls[0] < 60  # the rows of these buckets, and no others, were read
    now = {x["doc_key"]: x["text"] for x in buckets.stored(spark, root).collect()}
    assert len(now) == 501 and [k for k, v in now.items() if v == "new"] and sorted(k for k, v in now.items() if v == "new") == ["d1", "d2", "x"]
    # The same batch again, after a crash that left only some folders replaced: it is not applied to its own result.
    assert buckets.change(batch, 7, root, "w", ("doc_key",), apply) == touched and len(calls) == 1
    # A bucket that loses all its rows is empty, not as it was.
    assert buckets.change(batch.limit(1), 8, root, "w", ("doc_key",), lambda now, changed: now.limit(0)) and buckets.stored(spark, root).where("doc_key = 'd1'").isEmpty()
    assert buckets.change(batch.limit(0), 9, root, "w", ("doc_key",), apply) == []


def test_stale_documents_by_watermark_and_by_clock(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    rows = [("a", "pending", at(0), 0), ("a", "ready", at(30), 0), ("b", "pending", at(0), 0), ("b", "ready", at(200), 1), ("c", "pending", at(10), 0), ("d", "pending", at(500), 2), ("e", "pending", at(1), 0), ("e", "pending", at(90), 1), ("z", "ready", at(600), 2)]
    frame = spark.createDataFrame(rows, "doc_key string, status string, ts string, file int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((x["doc_key"], x["since"].second + 60 * x["since"].minute) for x in streamed(spark, tmp_path, frame, lambda s: jobs.stale_pending(s, 100, "10 seconds"), 3))
    assert got == [("b", 0), ("c", 10), ("e", 90)]
    shape = "doc_key string, status string, ts timestamp"
    old = spark.createDataFrame([("a", "pending"), ("b", "ready")], "doc_key string, status string").withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    old.write.parquet(str(tmp_path / "clock"))
    query = jobs.stale_pending(spark.readStream.schema(shape).parquet(str(tmp_path / "clock")), 5, clock=True).writeStream.format("memory").queryName("clocked").outputMode("append").option("checkpointLocation", str(tmp_path / "cc")).trigger(processingTime="1 second").start()
    for _ in range(60):
        query.awaitTermination(1)
        if spark.table("clocked").count():
            break
    query.stop()
    assert [(x["doc_key"], x["status"]) for x in spark.table("clocked").collect()] == [("a", "failed")]


def test_golden_validation(spark):
    rows = [("a", "happy_path", ["k"]), ("b", "odd", ["k"]), ("c", "edge_case", []), ("d", "adversarial", ["k"]), ("d", "adversarial", ["k"])]
    got = {(x["case_id"], x["reason"]) for x in ev.validate_golden(spark.createDataFrame(rows, "case_id string, category string, keys array<string>")).collect()}
    assert got == {("a", None), ("b", "category"), ("c", "no gold"), ("d", "repeated id")}
    cases = spark.createDataFrame([(1, "how many are there in all", "the answer is 42 indeed", "well, the answer is 42 indeed"), (2, "why not 1234567890 abc", "plain words here", "plain words here 1234567890")], "case_id long, question string, excerpt string, indexed string")
    assert [(x["reason"], x["leak"]) for x in ev.validate_candidates(cases).orderBy("case_id").collect()] == [(None, False), (None, True)]


def test_policy_paths(spark):
    rows = [("/w/u/a/../b", True), ("/w/u/../x", False), ("a/b", True), ("../u/c", True), ("../v", False), ("/w/user", False)]
    calls = spark.createDataFrame([("read", ["fs"], None, [p], "/w/u") for p, _ in rows], "tool string, capabilities array<string>, command string, paths array<string>, cwd string")
    got = {x["paths"][0]: x["allowed"] for x in g.evaluate_policy(calls, {"path_sandbox": True}).collect()}
    assert got == dict(rows)
    closed = g.evaluate_policy(calls.withColumn("capabilities", F.lit(None).cast("array<string>")), {"allow_capabilities": ("fs",)}).select("reason").distinct().collect()
    assert [x["reason"] for x in closed] == ["no capabilities"]


def test_rate_windows(spark):
    times = [(1, i, i * 2.8) for i in range(21)] + [(1, 21, 60.0), (2, 22, 5.0)]
    events = spark.createDataFrame(times, "user_id long, event_id long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {x["event_id"]: (x["place"], x["allowed"]) for x in g.rate_windows(events).collect()}
    assert got[19] == (20, True) and got[20] == (21, False) and got[21] == (1, True) and got[22] == (1, True)


def test_retention_and_labels(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-09",), (None,)], "day string")
    assert {x["day"] for x in g.retained(rows, 3, "2024-01-10").collect()} == {"2024-01-09", None} and g.retained(rows, 0, "2024-01-10").count() == 3
    with pytest.raises(ValueError):
        g.counters(rows, ("user_id",))


def test_memory_writes_equal_a_plain_loop(spark):
    rng = random.Random(1)
    pool = [f"t{i}" for i in range(12)]
    rows = [(i, rng.randrange(3), " ".join(rng.sample(pool, rng.randint(4, 7)))) for i in range(1, 120)] + [(200, 0, "!!"), (201, 0, None), (202, 1, "项目代号是 Orion"), (203, 1, "项目代号是 Orion")]
    rows += [(300 + i, i % 3, " ".join(rng.sample(pool[:5], 5))) for i in range(40)] + [(400 + i, 0, f"t{i % 2} t6 t7 t8") for i in range(40)]
    state, batch = rows[:30], rows[30:]
    kept = [x for x in state]
    terms = lambda s: set(__import__("re").findall("[a-z0-9_]+|[一-鿿]", (s or "").lower()))
    for x in batch:
        own = terms(x[2])
        if own and not any(k[1] == x[1] and len(own & terms(k[2])) / len(own | terms(k[2])) >= 0.6 for k in kept):
            kept.append(x)
    want = {x[0] for u in range(3) for x in sorted((k for k in kept if k[1] == u), reverse=True)[:25]}
    frame = lambda xs: spark.createDataFrame(xs, "id long, user_id long, text string").withColumn("superseded_by", F.lit(None).cast("long"))
    assert {x["id"] for x in m.apply_memories(frame(state), frame(batch), 25, 0.6).collect()} == want


def test_copies_of_memories_cost_no_pairs(spark):
    """Equal term sets are one class of its smallest id; classes pair as their sets do, users apart, and null users are a user for classes."""
    rows = [(i, 1, "b a c d") for i in range(10, 60)] + [(i, 1, "d c b a A") for i in range(60, 90)] + [(5, 1, "a b c e"), (6, 2, "a b c d"), (7, None, "x y"), (8, None, "y x"), (9, 1, "?!"), (91, 1, None)]
    frame = spark.createDataFrame(rows, "id long, user_id long, text string")
    classes = {x["id"]: x["class_id"] for x in m.memory_classes(frame).collect()}
    assert classes == {**{i: 10 for i in range(10, 90)}, 5: 5, 6: 6, 7: 7, 8: 7}
    assert [tuple(x) for x in m.jaccard_pairs(frame, 0.6).collect()] == [(1, 5, 10, 0.6)]
    assert m.memory_classes(frame.limit(0)).count() == m.jaccard_pairs(frame.limit(0)).count() == 0


def test_memory_writes_settle_long_chains(spark):
    """Each row is like its neighbour only, so every other one stays, however long the chain."""
    rows = [(i, 1, " ".join(f"t{k}" for k in range(i, i + 8))) for i in range(60)]
    frame = lambda xs: spark.createDataFrame(xs, "id long, user_id long, text string").withColumn("superseded_by", F.lit(None).cast("long"))
    got = m.apply_memories(frame(rows[:1]), frame(rows[1:]), 500, 0.75).collect()
    assert sorted(x["id"] for x in got) == list(range(0, 60, 2))


def test_judged_memory_writes(spark):
    """Duplicates are refused, contradictions take the older one's place and leave it as history, all in the order of ids."""
    state = spark.createDataFrame([(1, 1, "lives in hangzhou", None), (2, 1, "likes green tea", None), (3, 2, "lives in paris", None), (4, 1, "lives in rome", 1)], "id long, user_id long, text string, superseded_by long")
    batch = spark.createDataFrame([(10, 1, "lives in shanghai"), (11, 1, "likes green tea much"), (12, 1, "lives in beijing"), (13, 2, "owns a cat"), (14, 1, "!!"), (15, 1, "lives in hangzhou again")], "id long, user_id long, text string")

    def judge(pairs):
        same = F.array_contains(F.split("newer_text", " "), F.split("older_text", " ")[0])
        verdict = F.when(same & F.startswith("newer_text", F.lit("likes")), "duplicate").when(same & F.startswith("newer_text", F.lit("lives")), "conflict")
        return pairs.withColumn("verdict", verdict)

    got = {x["id"]: x["superseded_by"] for x in m.apply_memories(state, batch, 500, judge=judge).collect()}
    assert got == {1: 10, 2: None, 3: None, 4: 1, 10: 12, 12: 15, 13: None, 15: None}
    silent = m.apply_memories(state, batch, 500, judge=lambda pairs: pairs.withColumn("verdict", F.lit(None).cast("string")))
    assert sorted(x["id"] for x in silent.collect()) == [1, 2, 3, 4, 10, 11, 12, 13, 15]
    assert m.apply_memories(state, batch.limit(0), 2).count() == 3


def test_memory_history_follows_chains(spark):
    rows = [(1, 2), (2, 3), (3, 4), (4, None), (9, None)]
    got = {x["id"]: (x["latest"], x["steps"]) for x in m.history(spark.createDataFrame(rows, "id long, superseded_by long")).collect()}
    assert got == {1: (4, 3), 2: (4, 2), 3: (4, 1), 4: (4, 0), 9: (9, 0)}


def test_flywheel(spark):
    event = "struct<type:string,is_error:boolean,latency_ms:int>"
    schema = f"sample_no long, task_id string, trajectory struct<run_id:string,started_at:double,events:array<{event}>>, messages array<struct<role:string,content:string>>, scorer string, score double, passed boolean, passed_count int, total_count int"
    ok, bad = ("ToolCall", False, 1), ("ToolCall", True, 2)
    msg = [("user", "q")]
    rows = [
        (1, "a", ("r1", 0.0, [ok]), msg, "tests", 0.0, False, 9, 10), (2, "a", ("r2", 9.0, [("ToolCall", False, 7)]), msg, "tests", 0.0, False, 9, 10), (3, "a", ("r3", 0.0, [bad]), msg, "tests", 0.0, False, 5, 10),
        (4, "a", ("r4", 0.0, []), msg, "tests", 0.0, False, 5, 10), (5, "a", ("r5", 0.0, [bad, ok]), msg, "tests", 0.0, True, 10, 10), (6, "a", ("r6", 0.0, [ok, ok]), msg, "judge", 0.8, True, None, None), (7, "a", ("r7", 0.0, [ok, ok, ok]), msg, "tests", 0.0, False, 7, 10),
    ]
    kept, out = fw.build_training_sets(spark.createDataFrame(rows, schema), "sys")
    assert [x["sample_no"] for x in kept.orderBy("place").collect()] == [5, 1, 6]
    assert {k: sorted(x["sample_no"] for x in v.collect()) for k, v in out.items()} == {"sft": [5], "rlvr": [1, 5], "judge": [6]}
    assert out["sft"].first()["line"] == '{"messages":[{"role":"system","content":"sys"},{"role":"user","content":"q"}]}'


def test_blocks_and_sections(spark):
    text = "# 第一章\n## 1.1 背景\npara one\nsame\n\n- a\n- b\n## 1.2 方法\n```py\n# not a heading\n\nx\n```\n| a | b |\n| 1 | 2 |\n# 第二章\nlast"
    blocks = c.section_paths(c.text_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("block").collect()
    assert [(b["kind"], b["title_path"]) for b in blocks] == [
        ("heading", "第一章"), ("heading", "第一章 > 1.1 背景"), ("paragraph", "第一章 > 1.1 背景"), ("list", "第一章 > 1.1 背景"), ("heading", "第一章 > 1.2 方法"), ("code", "第一章 > 1.2 方法"), ("table", "第一章 > 1.2 方法"), ("heading", "第二章"), ("paragraph", "第二章"),
    ]
    assert blocks[5]["text"] == "# not a heading\n\nx" and blocks[2]["text"] == "para one\nsame"


def test_repeated_lines_count_empty_pages(spark):
    """A line on two of eight pages, five of them blank, is below the threshold of three; on three of eight it repeats."""
    lines = lambda hits: [(1, p, p, "A running head" if p < hits else "") for p in range(8)] + [(1, 1, 9, "body text")]
    for hits, left in ((2, 3), (3, 1)):
        frame = spark.createDataFrame(lines(hits), "doc_id long, page int, at int, line string")
        assert c.strip_repeated_lines(frame).count() == left
        total = sum(len(x[3]) for x in lines(hits)) + 1
        assert c.contamination_ratio(frame).first()["ratio"] == pytest.approx(0 if hits == 2 else 42 / total, abs=1e-6)


def plain_chunks(blocks, target, hard, overlap, least):
    """Block by block from the rules: (kind, path, text) of one document's (kind, path, text)."""
    import re

    def pieces(text, atomic):
        if len(text) <= hard:
            return [text]
        units = text.split("\n") if atomic else re.split(r"(?<=[。！？；!?;])|(?<=[.])\s+", text)
        if not atomic:
            units = [u for s in units if s.strip() for u in ([s] if len(s) <= hard else [s[k : k + hard] for k in range(0, len(s), max(1, hard - overlap))])]
        made, now = [], None
        for u in (u for u in units if u.strip()):
            grown = u if not now else now + ("\n" if atomic else "") + u
            if now and len(grown) > hard:
                made.append(now.strip())
                end = "" if atomic or not overlap else now[-overlap:]
                signs = [k for k in range(1, len(end)) if end[k] in "。！？；!?;.\n"]
                lead = end[signs[0] :].strip() if signs else ""
                grown = lead + u
            now = grown
        return made + ([now.strip()] if now and now.strip() else [])

    first, room = [], None
    for kind, path, text in blocks:
        if kind == "heading":
            room = None
        elif kind in ("table", "code") or len(text) > hard:
            first += [[kind, path, p] for p in pieces(text, kind in ("table", "code"))]
            room = None
        elif room is not None and room + len(text) <= target:
            first[-1][2] += "\n\n" + text
            room += len(text)
        else:
            first.append(["paragraph", path, text])
            room = len(text)
    first = [[k, p, t.strip()] for k, p, t in first]
    prose = lambda x: x[0] not in ("table", "code")
    like = lambda x, y: prose(x) and x[:2] == y[:2] and len(x[2]) + len(y[2]) + 2 <= hard
    once = []
    for x in first:
        if once and prose(x) and len(x[2]) < least and like(once[-1], x):
            once[-1][2] += "\n\n" + x[2]
        else:
            once.append(x)
    done = []
    while once:
        x = once.pop(0)
        if prose(x) and len(x[2]) < least:
            later = [y for y in once if like(y, x)]
            if later:
                later[0][2] = x[2] + "\n\n" + later[0][2]
                continue
            before = []
            for y in reversed(done):
                if prose(y) and y[1] != x[1]:
                    break
                before.append(y)
            host = [y for y in before if like(y, x)]
            if host:
                host[0][2] += "\n\n" + x[2]
                continue
        done.append(x)
    return done


@pytest.mark.parametrize("target, hard, overlap, least", [(80, 130, 25, 30), (60, 90, 0, 20), (800, 2000, 120, 100)])
def test_chunks_equal_a_plain_walk(spark, sf, target, hard, overlap, least):
    """On random blocks, and on the blocks of all pages and documents."""
    rng = random.Random(4)
    rows = []
    for doc in range(60):
        for block in range(rng.randint(1, 25)):
            kind = rng.choice(["paragraph"] * 5 + ["list", "heading", "table", "code"])
            text = " ".join(rng.choice(["alpha", "be.", "gam!", "中文。", "de;lta", "x\ny"]) for _ in range(rng.choice([1, 2, 5, 10, 30, 60])))
            rows.append((doc, block, kind, rng.randint(1, 3) if kind == "heading" else 0, rng.choice("ABC") if kind == "heading" else text))
    blocks = spark.createDataFrame(rows, "doc_id long, block int, kind string, level int, text string")
    if least == 100:
        pages = c.page_blocks(spark.read.parquet(f"{sf}/pages.parquet")).withColumnRenamed("page_id", "doc_id")
        blocks = pages.unionByName(c.text_blocks(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("doc_id", F.col("doc_id") + 100_000))
    named = c.section_paths(blocks).where(F.trim("text") != "").orderBy("doc_id", "block").collect()
    want = []
    for doc, own in groupby(named, key=lambda x: x["doc_id"]):
        want += [(doc, k, *x) for k, x in enumerate(plain_chunks([(x["kind"], x["title_path"], re.sub(r"[ \t]+\n", "\n", x["text"])) for x in own], target, hard, overlap, least))]
    got = ch.chunk(blocks, target, hard, overlap, least).select("doc_id", "seq", "kind", "title_path", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ingest_takes_what_a_heavier_parser_gives(spark):
    docs = spark.createDataFrame([(1, "good text of a document", 1, True), (2, "", 3, True), (3, "", 3, True)], "doc_id long, text string, pages int, scannable boolean").withColumn("text", F.when(F.col("doc_id") == 1, F.repeat("text", F.lit(9))).otherwise(F.col("text")))
    parse = lambda refused: refused.where("doc_id = 2").select("doc_id", F.lit("<p>read</p> <table><tr><td>a</td><td>b</td></tr></table>").alias("text"))
    plain = {x["doc_id"]: x["status"] for x in ch.ingest(docs)[0].collect()}
    out, chunks, _ = ch.ingest(docs, parse=parse)
    told = out.collect()
    assert plain == {1: "index_pending", 2: "needs_heavy_parser", 3: "needs_heavy_parser"}
    assert {x["doc_id"]: x["status"] for x in told} == {1: "index_pending", 2: "index_pending", 3: "needs_heavy_parser"}
    assert [x["text"] for x in chunks.where("doc_id = 2").collect()] == ["read | a | b |"]
    summary = {x["status"]: (x["docs"], x["stored"]) for x in c.ingest_summary(out).collect()}
    assert summary == {"index_pending": (2, 2), "needs_heavy_parser": (1, 0)}


def test_chunks(spark):
    rng = random.Random(0)
    long = "".join(f"Sentence number {i} says something. " for i in range(120))
    table = "\n".join(f"| row {i} | {'v' * rng.randint(5, 30)} |" for i in range(90))
    rows = [(1, 0, "heading", 1, "H"), (1, 1, "paragraph", 0, long), (1, 2, "table", 0, table), (1, 3, "paragraph", 0, "short one"), (1, 4, "code", 0, "x = 1"), (1, 5, "paragraph", 0, "tail"), (2, 0, "paragraph", 0, "a" * 500), (2, 1, "paragraph", 0, "b" * 500), (2, 2, "paragraph", 0, "c" * 50)]
    got = [x.asDict() for x in ch.chunk(spark.createDataFrame(rows, "doc_id long, block int, kind string, level int, text string")).orderBy("doc_id", "seq").collect()]
    for doc, own in groupby(got, key=lambda x: x["doc_id"]):
        assert [x["seq"] for x in own] == list(range(sum(x["doc_id"] == doc for x in got)))
    first = [x for x in got if x["doc_id"] == 1]
    assert all(x["title_path"] == "H" and x["embed_text"].startswith("H\n\n") for x in first)
    told = "".join(x["text"] for x in first)
    assert all(f"number {i} " in told for i in range(120)) and "\n".join(x["text"] for x in first if x["kind"] == "table") == table
    assert [x["text"] for x in first if x["kind"] == "code"] == ["x = 1"] and sum("short one" in x["text"] for x in first) == 1 and any("tail" in x["text"] and "short one" in x["text"] for x in first)
    assert [len(x["text"]) for x in got if x["doc_id"] == 2] == [500, 552]


def test_tables_and_sources(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k long, v string, created_at string")
    new = spark.createDataFrame([(2, None, "t9"), (3, "c", "t9")], "k long, v string, created_at string")
    assert sorted(map(tuple, tb.upsert(base, new, ("k",)).collect())) == [(1, "a", "t0"), (2, None, "t0"), (3, "c", "t9")]
    with pytest.raises(Exception, match="vector length"):
        tb.upsert_vectors(spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<double>"), spark.createDataFrame([(2, [1.0, 2.0])], "chunk_id long, embedding array<double>"), 1).collect()
    root = str(tmp_path / "t")
    src.publish(base, root)
    src.publish(new, root)
    assert src.published(spark, root).count() == 2 and {x["k"] for x in src.published(spark, root).collect()} == {2, 3}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.jsonl").write_text('{"run_id":"r","started_at":1.5,"events":[{"type":"ToolCall","call_id":"c","is_error":true}]}\nnot json\n{"x":1}\n')
    runs, broken = src.read_trajectories(spark, str(tmp_path / "runs"))
    assert [x["run_id"] for x in runs.collect()] == ["r"] and broken.count() == 2 and src.run_events(runs).first()["call_id"] == "c"
    src.write_trajectories(runs, str(tmp_path / "days"))
    assert spark.read.json(str(tmp_path / "days")).first()["day"] is not None
    (tmp_path / "golden.json").write_text('{"cases":[{"id":"a","category":"happy_path","gold_chunk_keys":["d#0"]},{"id":"b","category":"nope","gold_chunk_keys":["d#0"]}]}')
    good, bad = src.load_golden(spark, str(tmp_path / "golden.json"))
    assert [x["case_id"] for x in good.collect()] == ["a"] and [x["reason"] for x in bad.collect()] == ["category"]
    assert {(x["supported"]) for x in src.list_inputs(spark, str(tmp_path / "runs")).collect()} == {False}
    src.write_chunks(spark.createDataFrame([(1, 70, "x"), (2, 3, "y")], "chunk_id long, user_id long, text string"), str(tmp_path / "chunks"))
    assert [x["chunk_id"] for x in src.read_chunks(spark, str(tmp_path / "chunks"), [70]).collect()] == [1]


def streamed(spark, tmp_path, rows, make, parts):
    """The stream's rows over ``rows`` cut into files of their own, each a batch."""
    folder = tmp_path / "in"
    for k in range(parts):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(rows.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = make(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("seen").collect()


def test_reasoning_deltas(spark, tmp_path):
    pieces = ["a<th", "ink>b</", "think>c <", "d <thin"]
    rows = spark.createDataFrame([(1, k, p, k == 3, k) for k, p in enumerate(pieces)], "stream long, seq long, text string, last boolean, file int")
    got = sorted(streamed(spark, tmp_path, rows, jobs.reasoning_deltas, 4))
    whole = "".join(pieces)
    assert "".join(x["visible"] for x in got) == "ac <d <thin" and "".join(x["thinking"] for x in got) == "b"
    twin = spark.createDataFrame([(whole,)], "t string").select(tx.visible(F.col("t")), tx.thinking(F.col("t"))).first()
    assert tuple(twin) == ("ac <d <thin", "b")


def test_denial_alerts_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"r{i % 3}", i, rng.random() < 0.8, i // 40) for i in range(120)]
    frame = spark.createDataFrame(rows, "run_id string, pos long, denied boolean, file int")
    got = {(x["run_id"], x["pos"]) for x in streamed(spark, tmp_path, frame, lambda s: jobs.denial_alerts(s, 3), 3)}
    streaks, want = {}, set()
    for run, pos, denied, _ in rows:
        streaks[run] = streaks.get(run, 0) + 1 if denied else 0
        if streaks[run] == 3:
            want.add((run, pos))
    assert got == want
    alerts = t.denial_streaks(frame, 3).where("alert").count()
    assert alerts == len(want)


def test_ingest_stream(spark, tmp_path):
    root = str(tmp_path / "table")
    buckets.store(spark.createDataFrame([("a", 0, "old"), ("b", 0, "keep")], "doc_key string, seq int, text string"), root, ("doc_key",))
    spark.createDataFrame([("a", 0, "new", 1), ("a", 0, "newest", 2), ("a", 1, "more", 2)], "doc_key string, seq int, text string, version int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_key string, seq int, text string, version int").parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, root, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, buckets.stored(spark, root).collect())) == [("a", 0, "newest"), ("a", 1, "more"), ("b", 0, "keep")]
    jobs.append_by_day(spark.readStream.schema("doc_key string, seq int, text string, version int").parquet(str(tmp_path / "in")).withColumn("ts", F.lit("2024-01-02").cast("timestamp")), str(tmp_path / "days"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "days")).select("day").distinct().count() == 1


def test_audit_tasks_and_exports(spark, tmp_path):
    audit = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, None)], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):
        src.write_audit(audit, str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert back.count() == 6 and back.where("day = '2024-01-02'").select("event_id").distinct().collect()[0][0] == 2
    tasks = tmp_path / "tasks"
    tasks.mkdir()
    (tasks / "b.json").write_text('[{"id": "t2", "prompt": "p", "category": "c", "tags": ["x"], "scorer": "tests"}]')
    (tasks / "a.json").write_text('[{"id": "t3"}, {"id": "t1"}]')
    assert [(x["at"], x["id"]) for x in src.load_tasks(spark, str(tasks)).orderBy("at").collect()] == [(0, "t1"), (1, "t3"), (2, "t2")]
    src.write_exports({"sft": spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}')], "sample_no long, line string")}, str(tmp_path / "sets"))
    assert sorted(x["value"] for x in spark.read.text(str(tmp_path / "sets" / "sft")).collect()) == ['{"a":1}', '{"a":2}']
    assert [x["user_id"] for x in tb.first_users(spark.range(5, 0, -1).withColumnRenamed("id", "user_id"), 2).collect()] == [1, 2]


def test_memory_stream_equals_the_batch(spark, tmp_path):
    shape = "id long, user_id long, text string, superseded_by long"
    root, source = str(tmp_path / "memories"), tmp_path / "writes"
    buckets.store(spark.createDataFrame([(1, 1, "the code name is orion", None)], shape), root, ("user_id",))
    writes = [[(2, 1, "the code name is orion"), (3, 1, "tea at five")], [(4, 1, "tea at five"), (5, 2, "tea at five")]]
    for k, rows in enumerate(writes):
        spark.createDataFrame(rows, "id long, user_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long, user_id long, text string").parquet(str(source))
        jobs.memory_stream(stream, root, str(tmp_path / "c")).awaitTermination()
    assert sorted(x["id"] for x in buckets.stored(spark, root).collect()) == [1, 3, 5]


def test_state_goes_when_it_tells_nothing(spark, tmp_path):
    """A finished reasoning stream, a run without a streak: no row of state is left."""
    deltas = spark.createDataFrame([(1, 0, "<think>a", False), (1, 1, "b</think>c", True), (2, 0, "<thi", False)], "stream long, seq long, text string, last boolean")
    calls = spark.createDataFrame([("x", 0, True), ("x", 1, False), ("y", 0, True)], "run_id string, pos long, denied boolean")
    for name, frame, job, left in (("deltas", deltas, jobs.reasoning_deltas, 1), ("calls", calls, jobs.denial_alerts, 1)):
        frame.write.parquet(str(tmp_path / name))
        stream = job(spark.readStream.schema(frame.schema).parquet(str(tmp_path / name)))
        query = stream.writeStream.format("memory").queryName(f"state_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == left
