"""Merkle dataset manifest: ternary hash trees per source and over the sources, proofs and folds by cogrouped subtree exchange.

A row's leaf is hashed where the row is read, so texts never travel.  Leaves are numbered per source in two passes over
sorted ranges (``numbered``).  ``WIDTH`` = 3^7 leaves that follow each other are a superblock; ``climb`` reduces each
superblock of a level to its node (``applyInPandas``), and these nodes again, until every tree is one node: a source of
10^12 rows takes four steps.  The sources' subroots, numbered by source, are one more tree and climb alike.

On the way down (``descend``) the nodes of a level and what their superblock needs from outside (its own path to the root, one row)
are cogrouped by superblock in ``applyInPandas``: the task finishes the local reduction, which gives each node its
siblings inside, and joins them with the path outside.  At the leaves the same task folds the tampered leaf along the path.

Superblocks share tasks by a hash of (tree, block), so sources of few rows do not make a task or group each; a group holds the
rows of a few superblocks at most, and a source of any size is many superblocks.

Defined results: a null field is ``-`` in the leaf, a null doc_id comes first in its source and is never tampered with; the null
source is a source of its own, before all others; rows that share source and doc_id follow each other by leaf, so equal rows
take neighbouring places; empty texts and very long ones are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agentlake.operators.numbering import numbered

from .common import staged, table

ARITY, WIDTH = 3, 3**7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "tree string, pos long, total long, hash string"
_PATH = "tree string, pos long, path string, subroot string, root string"
_PROOF = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(hashes: list[str], total: int, width: int) -> list[list[str]]:
    """The nodes of each level, from ``hashes`` up to one: of a whole tree of ``total`` nodes, or of a superblock of a larger one (always all its levels)."""
    out, whole = [hashes], total <= width
    while len(out[-1]) > 1 if whole else width > 1:
        last = out[-1]
        out.append([_sha("".join(last[k : k + ARITY])) for k in range(0, len(last), ARITY)])
        width //= ARITY
    return out


def siblings(levels: list[list[str]], place: int) -> str:
    """The path of one node: per level its place in its run and the run's other nodes."""
    steps = []
    for nodes in levels[:-1]:
        first = place - place % ARITY
        steps.append(f"{place % ARITY}" + "".join(h for k, h in enumerate(nodes[first : first + ARITY], first) if k != place))
        place //= ARITY
    return ",".join(steps)


def joined(*paths: str) -> str:
    return ",".join(p for p in paths if p)


def proof_of(path: str) -> str:
    return _sha("".join(step[1:] for step in path.split(",")))


def folded(leaf: str, path: str) -> str:
    """The root that ``leaf`` gives along ``path``."""
    for step in filter(None, path.split(",")):
        left = 1 + 64 * int(step[0])
        leaf = _sha(step[1:left] + leaf + step[left:])
    return leaf


def _block(width: int) -> Column:
    return F.floor(F.col("pos") / width).cast("long")


def _slotted(nodes: DataFrame, block: Column, slots: int) -> DataFrame:
    return nodes.withColumn("block", block).withColumn("slot", F.pmod(F.xxhash64("tree", "block"), F.lit(slots)))


def _slots(nodes: DataFrame, width: int) -> int:
    """Groups of about a superblock each."""
    return 1 + nodes.count() // width


def _trees(rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    yield from rows.sort_values("pos", kind="stable").groupby(["tree", "block"], dropna=False, sort=False)


def _up(rows: pd.DataFrame, width: int) -> pd.DataFrame:
    out = []
    for (tree, block), part in _trees(rows):
        total = int(part["total"].iloc[0])
        levels = levels_of(part["hash"].tolist(), total, width)
        out.append((None if pd.isna(tree) else tree, block, -(-total // width), levels[-1][0]))
    return pd.DataFrame(out, columns=["tree", "pos", "total", "hash"])


def climb(nodes: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """The nodes (tree, pos, total, hash) of each step, up to one per tree; staged, as they are read on the way up and down."""
    steps = [nodes]
    while not steps[-1].where("total > 1").isEmpty():
        steps.append(staged(_slotted(steps[-1], _block(width), _slots(steps[-1], width)).groupBy("slot").applyInPandas(lambda rows: _up(rows, width), _NODE)))
    return steps


def _outside(outer: pd.DataFrame) -> dict[tuple, tuple]:
    return {(None if pd.isna(t) else t, p): (path, sub, root) for t, p, path, sub, root in zip(outer["tree"], outer["pos"], outer["path"], outer["subroot"], outer["root"])}


def _paths(rows: pd.DataFrame, outer: pd.DataFrame, width: int) -> Iterator[tuple[pd.DataFrame, list[list[str]], tuple]]:
    """(rows of a superblock, their levels, and what lies outside) of a group."""
    outside = _outside(outer)
    for (tree, block), part in _trees(rows):
        yield part, levels_of(part["hash"].tolist(), int(part["total"].iloc[0]), width), outside[None if pd.isna(tree) else tree, block]


def _down(rows: pd.DataFrame, outer: pd.DataFrame, width: int) -> pd.DataFrame:
    out = []
    for part, levels, (path, sub, root) in _paths(rows, outer, width):
        for k, (tree, pos) in enumerate(zip(part["tree"], part["pos"])):
            out.append((None if pd.isna(tree) else tree, pos, joined(siblings(levels, k), path), sub, root))
    return pd.DataFrame(out, columns=["tree", "pos", "path", "subroot", "root"])


def _finish(rows: pd.DataFrame, outer: pd.DataFrame, width: int) -> pd.DataFrame:
    out = []
    for part, levels, (path, sub, root) in _paths(rows, outer, width):
        for k, (doc, leaf, tampered) in enumerate(zip(part["doc"], part["hash"], part["tampered"])):
            whole = joined(siblings(levels, k), path)
            back = folded(leaf if tampered is None else tampered, whole)
            out.append((doc, leaf, sub, root, proof_of(whole), back, back == root))
    return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _of_width(work: Callable, width: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda rows, outer: work(rows, outer, width)


def descend(steps: list[DataFrame], outer: DataFrame, width: int = WIDTH, finish=_down, schema: str = _PATH) -> DataFrame:
    """The path of every node of the first step; ``outer`` has that of the trees' roots, at pos 0.  ``finish`` works on the first step."""
    for k in reversed(range(len(steps))):
        slots = _slots(steps[k], width)
        mine = _slotted(steps[k], _block(width), slots).groupBy("slot")
        theirs = _slotted(outer, F.col("pos"), slots).groupBy("slot")
        outer = mine.cogroup(theirs).applyInPandas(_of_width(_down if k else finish, width), _PATH if k else schema)
        if k:
            outer = staged(outer)
    return outer


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(shown.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_of(text: Column) -> Column:
    """The digest of a row with ``text`` as its text."""
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)).cast("binary"), 256)


def tampered_text() -> Column:
    return F.replace(F.col("text"), F.lit("\n"), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, doc (it, as text: pandas has no nulls among integers), tree (the source), hash, and the tampered leaf where the document is tampered with and has what is deleted."""
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(*FIELDS).select("doc_id", F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("tree"), leaf_of(F.col("text")).alias("hash"), F.when(chosen, leaf_of(tampered_text())).alias("tampered"))


def with_totals(nodes: DataFrame) -> DataFrame:
    """The number of nodes of each tree, as ``total``; a small table of trees meets the nodes."""
    sizes = nodes.groupBy(F.col("tree").alias("of")).agg((F.max("pos") + 1).alias("total"))
    return nodes.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).drop("of")


def manifest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    own = staged(with_totals(numbered(leaves(docs), ["doc_id", "hash"], ("tree",), "pos").drop("doc_id")))
    steps = climb(own, width)
    subroots = steps[-1].select(F.col("tree").alias("source"), F.col("hash"))
    sources = staged(numbered(subroots, ["source"], name="pos").withColumns({"tree": F.lit(""), "total": F.lit(subroots.count()).cast("long")}))
    top = climb(sources, width)
    root = top[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    above = descend(top, root, width)
    outer = sources.select("source", F.col("pos").alias("at"), F.col("hash").alias("subroot")).join(above.select(F.col("pos").alias("at"), "path", "root"), "at")
    proofs = descend(steps, staged(outer.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")), width, _finish, _PROOF)
    return proofs.withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_manifest": op13_manifest}
#: There is no CRC32 in the SQL of the comparison; the tests build the trees one by one.
SQL: dict[str, str] = {}
