"""All-pairs work by tiles: the results of pair by pair, with no record for each pair or shared term in a shuffle."""

import math
import random
from collections import Counter

import pytest

from agentlake.functions import text as tx
from agentlake.operators import evaluation as ev, memory as m, retrieval as r, tiles
from agentlake.plans import catalog


def shuffled(spark, run):
    """What ``run`` gives, and the records that its stages wrote to shuffles."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    small = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = written()
    try:
        for name in small:
            spark.conf.set(name, "-1")  # as for larger tables
        return run(), written() - before
    finally:
        for name in small:
            spark.conf.unset(name)


def wordy(n, users=3, seed=1):
    """Texts of a few very common words and some rare ones."""
    r = random.Random(seed)
    return [(i, i % users, " ".join(r.sample([f"c{x}" for x in range(16)], 10) + [f"r{r.randrange(300)}" for _ in range(r.randrange(12))]), None) for i in range(n)]


MEMORIES = "id long, user_id long, text string, superseded_by long"


@pytest.fixture
def small_parts(monkeypatch):
    """A part holds some 40 rows, so that users have several."""
    monkeypatch.setattr(tiles, "ITEMS", 600)


def near_pairs(rows, threshold):
    sets = {}
    for i, u, text, _ in rows:
        sets.setdefault((u, frozenset(text.split())), i)
    each = [(i, u, t) for (u, t), i in sets.items()]
    return {(u, min(i, j), max(i, j), round(len(t & s) / len(t | s), 6)) for i, u, t in each for j, v, s in each if u == v and i < j and len(t & s) / len(t | s) >= threshold}


def test_apply_memories_shuffles_no_record_for_each_shared_term(spark, small_parts):
    rows = wordy(600, 1)
    state, batch = (spark.createDataFrame(part, MEMORIES) for part in (rows[:200], rows[200:]))
    got, records = shuffled(spark, lambda: {x["id"] for x in m.apply_memories(state, batch, 500, 0.5).collect()})
    near, kept = {}, []
    for _, i, j, _ in near_pairs(rows, 0.5):
        near.setdefault(j, set()).add(i)
    first = {}
    for i, _, text, _ in rows:
        if i < 200 or not near.get(i, set()) & set(kept) and first.setdefault(frozenset(text.split()), i) == i:
            kept.append(i)
            first.setdefault(frozenset(text.split()), i)
    assert got == set(kept[-500:])
    assert records < 30_000


def test_jaccard_pairs_of_all_parts(spark, small_parts):
    rows = wordy(600)
    got, records = shuffled(spark, lambda: [tuple(x) for x in m.jaccard_pairs(spark.createDataFrame(rows, MEMORIES), 0.6).collect()])
    assert len(got) == len(set(got)) and set(got) == near_pairs(rows, 0.6)
    assert records < 30_000
    odd = [(1, None, "a b c", None), (2, None, "a b c d", None), (3, 1, "", None), (4, 1, None, None), (5, 1, "x y", None), (6, 1, "z", None)]
    assert m.jaccard_pairs(spark.createDataFrame(odd, MEMORIES), 0.0).count() == 0


def asked_of(spark, rows):
    """Every third row asks; every fifth of them could not be embedded."""
    frame = spark.createDataFrame(rows, MEMORIES)
    return frame.where("id % 3 = 0").selectExpr("id as query_id", "user_id", "text", "id % 5 = 0 as embed_failed"), frame


def best_overlaps(rows, k):
    sets = [(i, u, frozenset(text.split())) for i, u, text, _ in rows]
    out = {}
    for q, u, t in sets:
        if q % 3 == 0:
            ranked = sorted(((-len(t & s), -i) for i, v, s in sets if u == v and t & s))[:k]
            out[q] = [(-i, n, len(t)) for n, i in ranked]
    return out


def test_memory_recall_by_tiles(spark, small_parts):
    rows = wordy(600)
    asked, frame = asked_of(spark, rows)
    hits = spark.createDataFrame([(0, 3, 1), (3, 9999, 1)], "query_id long, id long, rank int")
    got, records = shuffled(spark, lambda: sorted((x["query_id"], x["rank"], x["id"], x["outcome"]) for x in m.recall(asked, frame, hits, 3).collect()))
    want = [(q, n + 1, i, "embed_failed" if q % 5 == 0 else "lexical_fallback") for q, found in best_overlaps(rows, 3).items() if q for n, (i, _, _) in enumerate(found)]
    assert got == sorted([(0, 1, 3, "vector_hit"), *want])
    assert records < 60_000


def test_entity_scores_shuffle_terms_once(spark, small_parts):
    rows = wordy(300)
    asked, frame = asked_of(spark, rows)
    got, records = shuffled(spark, lambda: {(x["query_id"], x["id"]): x["score"] for x in m.entity_scores(asked, frame).collect()})
    terms = {r["id"]: set(r["t"]) for r in frame.select("id", tx.entity_terms("text").alias("t")).collect()}
    users = {i: u for i, u, _, _ in rows}
    n, df = Counter(users.values()), Counter((users[i], t) for i, ts in terms.items() for t in ts)
    want = {(q, i): sum(math.log((n[users[q]] + 1) / (1 + df[users[q], t])) for t in terms[q] & terms[i]) for q in terms if q % 3 == 0 for i in terms if users[q] == users[i]}
    want = {pair: s for pair, s in want.items() if s > 1e-6}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)
    assert records < 60_000


def test_candidate_union_of_tiles(spark, small_parts):
    rows = wordy(600)
    asked, frame = asked_of(spark, rows)
    vector = asked.selectExpr("query_id", "query_id as id", "1 as rank").union(asked.selectExpr("query_id", "cast(-1 as long)", "2"))
    got, records = shuffled(spark, lambda: sorted((x["query_id"], x["place"], x["id"]) for x in m.candidate_union(m.lexical_recall(asked, frame, 2), vector, 2, 3).collect()))
    want = []
    for q, found in best_overlaps(rows, 2).items():
        ids = list(dict.fromkeys([*(i for i, _, _ in found), q, -1]))[:3]
        want += [(q, n + 1, i) for n, i in enumerate(ids)]
    assert got == sorted(want)
    assert records < 60_000


def test_lexical_recall_of_all_parts(spark, small_parts):
    rows = wordy(600)
    asked, frame = asked_of(spark, rows)
    got, records = shuffled(spark, lambda: sorted((x["query_id"], x["rank"], x["id"], x["score"]) for x in m.lexical_recall(asked, frame, 3).collect()))
    assert got == sorted((q, n + 1, i, round(-s / size, 6)) for q, found in best_overlaps(rows, 3).items() for n, (i, s, size) in enumerate(found))
    assert records < 60_000


def vectors_of(n, dim=6, seed=2):
    """Vectors with copies, one of no length, one null, one with an unknown number and one of another length."""
    r = random.Random(seed)
    rows = [(i, 0, [round(r.uniform(-1, 1), 2) for _ in range(dim)]) for i in range(n)]
    rows[n // 2 :: 7] = [(i, 0, rows[3][2]) for i, _, _ in rows[n // 2 :: 7]]
    rows[1], rows[2], rows[4], rows[5] = (1, 0, [0.0] * dim), (2, 0, None), (4, 0, [1.0, None] + [0.0] * (dim - 2)), (5, 0, [1.0])
    return rows


def cosine(a, b):
    if not a or not b or None in a or None in b or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


@pytest.mark.parametrize("odd", [True, False])
def test_vector_topk_by_tiles(spark, monkeypatch, odd):
    rows = [(i, u, v) for i, u, v in vectors_of(900) if odd or i not in (1, 2, 4, 5)]
    monkeypatch.setattr(tiles, "ITEMS", 1_500 if odd else 1 << 20)
    vectors = spark.createDataFrame(rows, "chunk_id long, user_id long, embedding array<double>")
    asked = vectors.where("chunk_id % 9 = 3 or chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    found = r.vector_topk(asked, vectors, 5)
    own = dict((i, v) for i, _, v in rows)
    want = []
    for q in own:
        if q % 9 == 3 or q < 6:
            ranked = sorted((-round(cosine(own[q], v), 6) + 0.0, i) for i, v in own.items())[:5]
            want += [(q, i, n + 1, round(-s + 0.0, 6)) for n, (s, i) in enumerate(ranked)]
    assert sorted((x["query_id"], x["chunk_id"], x["rank"], x["score"]) for x in found.collect()) == sorted(want)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_score_spread_counts_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ITEMS", 800)
    rows = [(i, u, i % 3 if i % 11 else None, v) for i, u, v in vectors_of(300)]
    frame = spark.createDataFrame(rows, "id long, user_id long, label int, embedding array<double>")
    counted = ev.labelled_scores(frame.where("id % 10 = 0"), frame)
    want = Counter((None if None in (a, b) else a == b, round(cosine(x, y), 6) + 0.0) for i, _, a, x in rows if i % 10 == 0 for j, _, b, y in rows if j > i)
    assert {(x["duplicate"], x["score"]): x["n"] for x in counted.collect()} == want
    spread = {x["duplicate"]: (x["min"], x["median"], x["max"]) for x in ev.score_spread(counted).collect()}
    for kind in (True, False):
        scores = sorted(s for (k, s), n in want.items() for _ in range(n) if k is kind)
        assert spread[kind] == (scores[0], scores[len(scores) // 2], scores[-1])


@pytest.fixture(scope="module")
def embedded(spark, tmp_path_factory):
    """All of 600 vectors ask, with two labels: 180,000 gold rows."""
    r, path = random.Random(3), str(tmp_path_factory.mktemp("embedded"))
    rows = [(i * 100, [r.gauss(0, 1) for _ in range(8)], i % 2) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["best_config", "eval_gate", "eval_by_tag", "case_diff", "eval_report", "score_cases", "ab_table", "eval_by_category"])
def test_scores_shuffle_no_gold_but_what_was_found(spark, embedded, name):
    rows, records = shuffled(spark, lambda: catalog.QUERIES[name](spark, embedded).count())
    assert rows > 0 and records < 120_000


@pytest.mark.parametrize("name", ["index_drift", "index_check"])
def test_index_checks_by_tiles(spark, embedded, name):
    found = catalog.QUERIES[name](spark, embedded)
    assert found.count() > 0
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_dose_response_stages_what_each_weight_reads(spark, sf):
    plan = catalog.QUERIES["dose_response"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in plan and len(plan) < 100_000 and "regexp_extract_all" not in plan
