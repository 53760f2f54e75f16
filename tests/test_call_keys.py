"""Canonical call keys against sorted JSON of the same values."""

import json
import random

from pyspark.sql import functions as F

from agentlake.functions.text import canonical_json
from agentlake.operators import governance as g, trajectory as t


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind == 0:
        return rng.choice((0, 1, -7, 10**25, 2**53 + 1, 12345678901234567890123456789012345678901234567890))
    if kind == 1:
        return rng.choice((0.5, 1.0, -2.25, 1e300, 1e-7, 0.1))
    if kind == 2:
        return rng.choice((True, False, None))
    if kind < 6:
        return rng.choice(("", "1", "1.0", "null", 'a "quoted" one', "back\\slash\\", "line\nbreak\ttab", "é中😀", '{"a":1}', "\\u0001", "\u00015", "x" * 3000 + "\\" * 7, ": 5, -3", "\\\""))
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(("a", "b", "path", "file", 'k"q', "\\", "é", "z1", "")): value(rng, depth + 1) for _ in range(rng.randrange(5))}


def shuffled(rng, x):
    if isinstance(x, dict):
        items = list(x.items())
        rng.shuffle(items)
        return {k: shuffled(rng, v) for k, v in items}
    return [shuffled(rng, v) for v in x] if isinstance(x, list) else x


def test_keys_equal_sorted_json(spark):
    rng = random.Random(1)
    made = [{f"k{j}": value(rng) for j in range(rng.randrange(1, 5))} for _ in range(1000)]
    plain = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows = [(i, plain(m), json.dumps(shuffled(rng, m), ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1)))) for i, m in enumerate(made)]
    df = spark.createDataFrame(rows, "i int, want string, given string")
    told = df.select("want", canonical_json(F.col("given")).alias("got"), t.call_key(F.lit("f"), F.col("given")).alias("key")).collect()
    assert [r["got"] for r in told] == [r["want"] for r in told]
    assert len({r["key"] for r in told}) == len({r["want"] for r in told})


def test_alike_calls_and_unlike_ones(spark):
    given = ['{"a":1}', '{"a":"1"}', '{"a":1.0}', '{"a":{"x":1,"y":2}}', '{ "a" : {"y":2, "x":1} }', None, "", "{}", "[1]", "not json", '{"a":1', '{"a":true}', '{"a":"true"}']
    keys = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, g string").orderBy("i").select(t.call_key(F.lit("f"), F.col("g"))).collect()]
    assert keys[3] == keys[4] and keys[5] == keys[6] == keys[7]
    assert len(set(keys)) == len(keys) - 3


def test_ledger_replays_only_the_same_call(spark):
    rows = [("r", 1, '{"a":{"y":1,"x":2}}', "first"), ("r", 2, '{"a":{"x":2,"y":1}}', "again"), ("r", 3, '{"a":{"x":"2","y":1}}', "other")]
    events = spark.createDataFrame([(r, p, "ToolCall", "f", a, x, False, False, False) for r, p, a, x in rows], "run_id string, pos int, type string, name string, arguments string, result string, denied boolean, unknown boolean, crashed boolean")
    assert sorted(r["result"] for r in t.tool_ledger(events).collect()) == ["again", "other"]


def test_paths_of_arguments(spark):
    cases = [
        ("read", '{"path":"/a","file":"no"}', ["/a"]), ("read", '{"path":""}', []), ("read", '{"path":0}', []), ("ls", '{"path":5}', ["5"]), ("read", "{}", []), ("read", None, []), ("read", '{"path":"/x"', []),
        ("mcp", '{"z":{"q":[{"dir":"/3"},{"file":["/no",{"path":"/4"}]}]},"file":"/1"}', ["/1", "/3", "/4"]), ("mcp", '{"path":5,"dir":"","file":null}', []),
        ("mcp", r'{"a":"\"path\":\"/no\"","path":"a\"b\\"}', ['a"b\\']), ("mcp", json.dumps({"x": "y" * 20_000 + '"' * 9000, "dir": "/d" + "\n" * 9000}), ["/d" + "\n" * 9000]),
    ]
    df = spark.createDataFrame([(i, tool, a) for i, (tool, a, _) in enumerate(cases)], "i int, tool string, a string")
    got = [list(r[0] or []) for r in df.orderBy("i").select(g.path_args(F.col("tool"), F.col("a"))).collect()]
    assert got == [want for *_, want in cases]
