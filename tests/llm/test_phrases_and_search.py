"""Operators 11 and 12 against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import op11_phrases as op11, op12_lexical as op12

SCHEMA = "doc_id long, text string, key long, sub string, spans int, n int, rank double, score int, ids string, item_id long"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA)


def sentence(rng, n, pool=300, stem="w"):
    return " ".join(f"{stem}{rng.randrange(pool)}" for _ in range(n))


def phrases_by_hand(rows, window=20):
    ordered = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    first, out = {}, {}
    places = {}
    for k, (_, _, text) in enumerate(ordered):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        for s in range(len(words) - window + 1):
            places.setdefault(tuple(words[s : s + window]), []).append((k, s))
    gone = [set() for _ in ordered]
    for at in places.values():
        for k, s in at[1:]:
            gone[k].update(range(s, s + window))
    for k, (there, doc, text) in enumerate(ordered):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone[k]).encode()
        out[there, doc, text] = (doc if there else None, len(words), len(gone[k]), hashlib.sha256(kept).hexdigest())
    return sorted((out[r[0] is not None, r[0] or 0, r[1] or ""] for r in rows), key=str)


def phrase_rows():
    rng = random.Random(4)
    base = [sentence(rng, 90) for _ in range(30)]
    passage, licence = sentence(rng, 55, stem="p"), sentence(rng, 21, stem="l")
    texts = list(base)
    for k in range(60):
        b = base[rng.randrange(30)].split()
        kind = k % 6
        if kind == 0:
            texts.append(" ".join(b))
        elif kind == 1:
            b[rng.randrange(len(b))] = f"edit{k}"
            texts.append("\n".join(b))
        elif kind == 2:
            at = rng.randrange(60)
            texts.append(f"{sentence(rng, 9)} {' '.join(b[at : at + rng.choice((19, 20, 21, 30))])} {sentence(rng, 12)}")
        elif kind == 3:
            texts.append(f"{sentence(rng, rng.randrange(30))} {passage}\t{licence} {sentence(rng, 5)}")
        elif kind == 4:
            texts.append(f"{licence} {licence} x{k} {licence}")
        else:
            texts.append(f"{sentence(rng, 25)} {passage[: rng.randrange(100, 300)]}")
    texts += [None, "", " \n ", "one", "la " * 70, "ba bb " * 40, sentence(rng, 5000, 40), "Ünï\x85cödé\xa0x 中文 " * 15, "z" * 3000, base[3].replace("w1", "W1")]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base[2]), (None, None), (9, f"other under a known id {base[7]}")]


@pytest.mark.parametrize("shape", ["plain", "tight"])
def test_repeated_phrases(spark, monkeypatch, shape):
    rows = phrase_rows()
    batch = op11.BATCH if shape == "plain" else 200
    if shape == "tight":
        monkeypatch.setattr(op11, "GROUP", 3)
        monkeypatch.setattr(op11, "FAN", 2)
    docs = table_of(spark, rows).repartition(7)
    got = op11.remove_phrases(docs, with_text=True, batch=batch).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == phrases_by_hand(rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert op11.remove_phrases(table_of(spark, [])).count() == 0


def test_texts_are_shuffled_once(spark):
    """Both joins of documents read one exchange, which holds compressed words."""
    rows = [(k, f"{sentence(random.Random(k % 7), 60)} {sentence(random.Random(100 + k), 200)}") for k in range(40)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = op11.remove_phrases(table_of(spark, rows))
        got = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted((tuple(r) for r in got), key=str) == phrases_by_hand(rows)
    assert "ReusedExchange" in plan and plan.count("SortMergeJoin") == 2
    words = op11.packed(op11.keyed(table_of(spark, rows))).agg(F.sum(F.length("words")), F.sum("size")).first()
    assert words[0] < words[1] == sum(len(" ".join(t.split()).encode()) for _, t in rows)


def test_long_texts_are_cut_into_chunks_without_loss():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    first, n, p, digest = op11.blocks(op11._mixed(h), np.ones(400 - 19, bool))
    assert n.sum() == 381 and first[0] == 0 and (first[1:] == np.cumsum(n)[:-1]).all() and n.max() <= 13


def shards_of(words, streams, batch):
    held = op11.Shards(batch)
    held.add(1, op11.PASSAGE, (1, 0, 10), b" ".join(words), [x for s in range(0, 381, 7) for x in (s, min(7, 381 - s))], None)
    for place, a, n in streams:
        held.add(1, op11.TEXT, place, b" ".join(words[a : a + n + 19]), None, a + 10)
    return held


@pytest.mark.parametrize("streams", [[((2, 0, 5), 0, 381), ((1, 0, 300), 98, 49), ((0, 0, 0), 98, 49)], [((k, 0, k), 7 * (k % 20), 140 + 7 * (k % 9)) for k in range(2, 60)]])
def test_slices_and_pieces_equal_one_automaton(streams):
    """Linked stretches, which are unions of blocks, or the blocks where these are fewer, whole and in small slices."""
    rng = random.Random(2)
    words = [w.encode() for w in sentence(rng, 400, 5000).split()]
    cover = lambda batch: {(k, b, s + j) for k, b, s, n in shards_of(words, streams, batch).located() for j in range(n)}
    want = {(*place[:2], place[2] + j) for place, a, n in streams for j in range(n) if (1, 0, a + 10) < place}
    assert cover(op11.BATCH) == cover(60) == want


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op11.op11_phrases(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == phrases_by_hand(rows)
    assert sum(r["n_removed"] for r in got) > 0


def hits_by_hand(docs, items, top=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(s for *_, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    out, by_item = [], {}
    for i, t in items:
        by_item.setdefault(i, Counter()).update(cut(t))
    for i, asked in by_item.items():
        scored = []
        for d, c, size in held:
            m = 25 + (75 * size * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d if d is not None else -(2**63), d))
        for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:top], 1):
            out.append((i, rank, d, -s))
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(6)
    texts = [sentence(rng, rng.randrange(1, 60), 120) for _ in range(400)]
    texts += [None, "", "...", "ÉCOLE École écoLe 中文 naïve", "w1_w2-W3 W1 w1\x00w5", sentence(rng, 20_000, 200), *texts[:5], texts[0], "the " * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[7]), (3, "another w5 w6 w7")]


ITEMS = [(1, "w1 w2 w3 w2 w2"), (2, "W5, w6! école É"), (3, None), (4, "nowhere"), (5, "w1 w2"), (5, "w9 w9"), (None, "w7 w8 the"), (6, "w4 " * 30 + "中文"), (7, sentence(random.Random(1), 300, 130))]


@pytest.mark.parametrize("shape", ["plain", "small"])
def test_ranked_search(spark, monkeypatch, shape):
    if shape == "small":
        for name, value in (("ITEMS", 2), ("RANKERS", 3)):
            monkeypatch.setattr(op12, name, value)
    rows = search_rows()
    items = table_of(spark, []).sparkSession.createDataFrame(ITEMS, "item_id long, text string").withColumnsRenamed({})
    got = op12.ranked_search(table_of(spark, rows).repartition(5), items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == hits_by_hand(rows, ITEMS)
    assert op12.ranked_search(table_of(spark, []), items).count() == 0
    assert op12.ranked_search(table_of(spark, rows), items.where("false")).count() == 0
    assert op12.ranked_search(table_of(spark, [(1, None), (2, "--")]), items).count() == 0


def test_trees_prune_and_miss_nothing():
    rng = np.random.default_rng(5)
    n, width = 3000, 400
    topic = rng.integers(0, 20, n)
    rows = [np.unique(np.concatenate((topic[k] * 20 + rng.integers(0, 20, 6), rng.integers(0, width, 2)))) for k in range(n)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    ids = np.concatenate(rows)
    values = rng.integers(1, 2**40, len(ids))
    vectors = op12.Vectors(np.arange(n), at, ids, values)
    root = op12.Node(vectors, width, 32)
    scored = 0
    for t in range(20):
        item = np.zeros(width, np.int64)
        item[t * 20 + rng.integers(0, 20, 8)] = rng.integers(1, 4, 8)
        best = []
        scored += op12.search(root, item, best)
        every = sorted(((int(s), -k) for k, s in enumerate(vectors.dot(item)) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == every
    assert scored < 0.6 * 20 * n


def test_bounds_hold_where_vectors_are_alike_or_huge():
    rng = np.random.default_rng(8)
    for scale in (1, 2**30, 2**44):
        base = rng.integers(1, 9, 12) * scale
        rows = np.tile(base, (300, 1)) + (rng.random((300, 12)) < 0.05)
        vectors = op12.Vectors(np.arange(300), np.arange(301) * 12, np.tile(np.arange(12), 300), rows.ravel())
        root = op12.Node(vectors, 12, 8)
        item = rng.integers(0, 3, 12)
        norm = math.sqrt(float(item @ item))
        waiting = [root]
        while waiting:
            node = waiting.pop()
            waiting += node.parts
            if node.rows is not None:
                assert node.rows.dot(item).max() <= node.bound(item, norm)
        best = []
        op12.search(root, item, best)
        assert sorted(best, reverse=True) == sorted(((int(s), -k) for k, s in enumerate(vectors.dot(item)) if s > 0), reverse=True)[:10]


def test_search_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    got = op12.op12_lexical(spark, sf)
    want = con.execute(op12.SQL["op12_lexical"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
