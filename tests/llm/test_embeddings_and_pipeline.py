"""Operator 3 against brute force, and the pipeline stage by stage."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from agentlake.llm import op03_embeddings as op3, op04_mixing as op4, op06_pii as op6, op08_simhash as op8
from agentlake.llm.common import staged

SCHEMA = "vec_id long, embedding array<float>, label int, node long, key string"


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for c in range(6):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.6])], c % 3))
    n = len(rows)
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(8)]
    rows += [(n + 20, rows[0][1], None), (n + 21, None, 1), (n + 22, [], 1), (n + 23, [0.0] * 16, 1), (n + 24, [float("nan")] * 16, 1), (n + 25, [None] * 16, 1), (n + 26, [float("inf")] + [0.0] * 15, 1), (n + 27, [1.0, 2.0], 1), (n + 28, [2.0, 4.0], 1), (None, rows[5][1], rows[5][2]), (3, rows[3][1], rows[3][2])]
    return [(*r, 1, "k") for r in rows]


def by_hand(rows, threshold):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    key = lambda r: -(2**63) if r[0] is None else r[0]
    links, up = Counter(), {i: i for i in range(len(rows))}
    at = {id(r): i for i, r in enumerate(rows)}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[at[id(a)]] += 1
                    links[at[id(b)]] += 1
                    up[root(at[id(a)])] = root(at[id(b)])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(key(r))
    back = lambda k: None if k == -(2**63) else k
    return Counter((r[0], links[i], back(min(groups[root(i)])), min(groups[root(i)]) == key(r)) for i, r in enumerate(rows))


def test_near_vectors(spark, monkeypatch):
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(op3, "ROWS", 16)
    for threshold, tile in ((0.93, 4096), (0.8, 7)):
        got = Counter(map(tuple, op3.near_vectors(frame, threshold, tile).collect()))
        assert got == by_hand(rows, threshold)
    assert op3.near_vectors(frame.limit(0)).count() == 0
    monkeypatch.setattr(op3, "BLOCK", 300)
    assert Counter(map(tuple, op3.near_vectors(frame, 0.93, 11).collect())) == by_hand(rows, 0.93)
    assert op3.near_vectors(frame.where("label is null")).collect()[0]["kept"]


def test_vectors_of_any_finite_size_are_compared(spark):
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(4, 6))
    rows = [(10 * k + j, [float(x) for x in unit[k] * scale], 1) for k in range(4) for j, scale in enumerate((1.0, 1e200, 1e-200, 1e300, 1e-300))]
    rows += [(90, [5e-324, 0.0, 0.0], 2), (91, [1.7e308, 0.0, 0.0], 2), (92, [1.7e308, 1.7e308, 0.0], 2), (93, [1e-310, 1e-310, 0.0], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op3.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.999).collect()}
    assert got == {10 * k + j: (4, 10 * k) for k in range(4) for j in range(5)} | {90: (1, 90), 91: (1, 90), 92: (1, 92), 93: (1, 92)}


def test_tiles_out_of_reach_never_meet(spark):
    """Vectors in far clusters along the leading axes: only tiles near each other are tasks, and none that links is left out."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:4] * 3
    rows = [(k, [float(x) for x in centres[k % 4] + rng.normal(size=8) * 0.05], 1) for k in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen, plain = [], op3.tile_pairs
    try:
        op3.tile_pairs = lambda blocks, reach: seen.append((blocks.select("tile").distinct().count(), plain(blocks, reach).where("tile = i").count())) or plain(blocks, reach)
        got = op3.near_vectors(frame, 0.93, 20).collect()
    finally:
        op3.tile_pairs = plain
    tiles, pairs = seen[0]
    assert tiles >= 8 and pairs < tiles * (tiles + 1) / 2 * 0.6
    assert {r["component_id"] for r in got} == {0, 1, 2, 3} and {r["n_links"] for r in got} == {99}


def test_components_of_paths_and_stars(spark):
    from agentlake.llm.components import components

    rng = random.Random(0)
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1001 + i) for i in range(100)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + star + [(5, 5)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(101)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = staged(stage(spark, docs, sf))
    return out


def test_pipeline_keeps_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "personal_data", "mixing", "packing"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def test_pipeline_stages_follow_their_operators(stages):
    rows = {n: df.collect() for n, df in stages.items()}
    ids = lambda n: Counter(r["doc_id"] for r in rows[n])
    assert set(ids("quality")) <= set(ids("documents")) and len(rows["quality"]) < len(rows["documents"])
    fps = [(r["doc_id"], op8.fingerprint(r["text"] or "")) for r in rows["quality"]]
    up = {k: k for k, _ in fps}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert set(ids("near_copies")) == {root(k) for k, _ in fps}
    model = op6.train(stages["near_copies"])
    before = {r["doc_id"]: r["text"] for r in rows["near_copies"]}
    for r in rows["personal_data"]:
        base, more = op6.all_spans([before[r["doc_id"]] or ""], model)[0]
        assert r["text"] == op6.redacted(before[r["doc_id"]], base + more) and r["n_chars"] == len(r["text"])
    mixed = op4.mixing(stages["personal_data"]).collect()
    assert ids("mixing") == Counter({r["doc_id"]: r["copies"] + (r["cut_words"] > 0) for r in mixed if r["copies"] + (r["cut_words"] > 0)})
    packed = defaultdict(int)
    for p in rows["packing"]:
        packed[p["doc_id"]] += p["length"]
    assert set(packed) == set(ids("mixing"))


def test_run_gives_the_last_stage(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == stages["packing"].columns
    assert got.selectExpr("sum(length)").first()[0] == stages["packing"].selectExpr("sum(length)").first()[0]


def test_stages_on_odd_rows_and_an_empty_table(spark, sf, stages):
    """Nulls in every column, shared ids, empty texts, repeated rows and extra columns pass all stages; so does no row at all."""
    plain = stages["documents"].limit(60)
    names = plain.columns
    odd = spark.createDataFrame([(None,) * len(names), (None,) * len(names)], plain.schema)
    docs = plain.unionByName(odd).unionByName(plain.limit(3)).withColumns({"doc": odd_column(), "size": odd_column(), "row": odd_column(), "key": odd_column()})
    for start in (docs, docs.limit(0)):
        at = staged(start)
        for name, stage in corpus_pipeline.STAGES:
            got = staged(stage(spark, at, sf))
            if name != "packing":
                assert got.columns == docs.columns
            assert start is docs or got.count() == 0
            at = got
    assert at.count() == 0


def odd_column():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")
