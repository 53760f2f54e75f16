"""Row numbers in two passes, and what is built on them, against sorting in one place."""

import json

from pyspark.sql import functions as F

from agentlake.operators import tables as tb
from agentlake.operators.numbering import numbered
from agentlake.sources import tables as sources


def test_numbers_follow_the_order_inside_groups(spark):
    rows = [(None if k % 5 == 0 else f"g{k % 3}", (k * 7919) % 1000, k) for k in range(2000)]
    got = numbered(spark.createDataFrame(rows, "g string, x long, id long").repartition(7), ["x", "id"], ("g",)).collect()
    for g in {r[0] for r in rows}:
        want = sorted((x, i) for h, x, i in rows if h == g)
        assert [(r["x"], r["id"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])] == want
        assert sorted(r["position"] for r in got if r["g"] == g) == list(range(len(want)))
    assert numbered(spark.createDataFrame([], "g string, x long"), ["x"], ("g",)).count() == 0


def test_one_hot_group_is_spread(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("g"), (F.col("id") * 37 % 50_000).alias("x"))
    got = numbered(df, ["x"], ("g",))
    assert got.where("position <> x").isEmpty() and got.count() == 50_000


def blocks_by_hand(names, order, rows, per=20):
    """rows: dicts."""
    texts = []
    for r in sorted(rows, key=lambda r: (r[order] is not None, r[order], "; ".join(f"{n}: {r[n]}" for n in names if str(r[n] or "").strip() not in ("", "?", "None", "nan")))):
        if any(str(r[n] or "").strip() for n in names):
            texts.append("; ".join(f"{n}: {r[n]}" for n in names if str(r[n] or "").strip() not in ("", "?", "None", "nan")))
    body = {k // per + 1: "\n".join(t for t in texts[k : k + per] if t) for k in range(0, len(texts), per)}
    return {0: f"columns({len(names)}): {', '.join(names[:20])}; rows: {len(texts)}"} | {k: t for k, t in body.items() if t}


def test_table_blocks_count_rows_whatever_the_key(spark):
    gapped = [{"k": 10 * i + (i % 3), "a": f"v{i}", "b": None if i % 4 else " spaced "} for i in range(95)]
    text_keys = [{"k": f"key{i % 17:03d}", "a": f"w{i:03d}", "b": "?" if i % 2 else "x"} for i in range(70)]
    marks = [{"k": i, "a": "?" if i < 20 else ("" if i == 25 else f"z{i}"), "b": None} for i in range(50)]
    for rows, kind in ((gapped, "long"), (text_keys, "string"), (marks, "long")):
        df = spark.createDataFrame([(r["k"], r["a"], r["b"]) for r in rows], f"k {kind}, a string, b string").repartition(3)
        assert {r["block"]: r["text"] for r in tb.table_blocks(df, "k").collect()} == blocks_by_hand(["a", "b"], "k", rows)
    assert [tuple(r) for r in tb.table_blocks(spark.createDataFrame([], "k long, a string"), "k").collect()] == [(0, "columns(1): a; rows: 0")]


def test_tasks_are_numbered_by_file_and_id(spark, tmp_path):
    for name, ids in (("b.json", ["t2", "t1"]), ("a.json", ["t9"])):
        (tmp_path / name).write_text(json.dumps([{"id": i, "prompt": f"do {i}", "category": "x", "tags": [], "scorer": "exact"} for i in ids]))
    assert [(r["at"], r["id"]) for r in sources.load_tasks(spark, str(tmp_path)).orderBy("at").collect()] == [(0, "t9"), (1, "t1"), (2, "t2")]
