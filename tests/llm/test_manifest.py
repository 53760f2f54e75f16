"""Operator 13 against trees that are built one by one."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from agentlake.llm import op13_manifest as op13

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, tree string, pos long, slot int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc, _, lang, source, n = row[:5]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(leaves):
    """root, and per leaf its runs (place, others)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k in range(len(leaves)):
            first = at[k] // 3 * 3
            run = nodes[first : first + 3]
            paths[k].append((at[k] - first, run[: at[k] - first] + run[at[k] - first + 1 :]))
            at[k] //= 3
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def by_hand(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        sources[s].sort(key=lambda x: x[:3])
        built[s] = tree([x[2] for x in sources[s]])
    root, tops = tree([built[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        sub, paths = built[s]
        for (_, _, own, r), path in zip(sources[s], paths):
            whole = path + top
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            back = leaf(r, r[1].replace("\n", "") if chosen and r[1] is not None else r[1])
            for place, others in whole:
                back = h(*others[:place], back, *others[place:])
            out.append((r[0], own, sub, root, h(*(x for _, others in whole for x in others)), back, back == root))
    return out


def rows_of(n, sources):
    text = lambda k: None if k % 13 == 0 else ("" if k % 11 == 0 else f"línea {k}\nsecond {'x' * (k % 50)}\n" if k % 3 else f"single {k}")
    return [(k * 7 % 10_007, text(k), "en" if k % 4 else None, sources(k), k if k % 5 else None, "p", "t", 1, 2, "r") for k in range(n)]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("n, sources", [(700, lambda k: None if k % 10 == 0 else ("hot" if k % 3 else f"s{k % 37}")), (40, lambda k: f"s{k}"), (30, lambda k: "one"), (1, lambda k: None), (10, lambda k: "é" if k % 2 else "z")])
def test_every_level_count(spark, n, sources):
    rows = rows_of(n, sources)
    if n > 100:
        long = (99_991, "word\n" * 200_000, "en", "hot", 1, *[None] * 5)
        rows += [rows[5], rows[5], rows[6][:1] + ("another\ntext",) + rows[6][2:], (None, "no id\nat all", "en", "hot", 3, *[None] * 5), (None,) * 10, long]
    assert found(op13.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), 9)) == sorted(by_hand(rows), key=str)


def test_superblocks_of_full_width(spark):
    rows = rows_of(7000, lambda k: "a" if k % 10 else f"s{k % 4}")
    got = found(op13.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(by_hand(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_empty_table(spark):
    assert op13.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = op13.op13_manifest(spark, sf)
    assert found(got) == sorted(by_hand([tuple(r) for r in docs.collect()]), key=str)
    assert got.where(F.col("folded_root") == F.col("root")).where("not verified").isEmpty()
