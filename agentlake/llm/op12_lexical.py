"""Ranked lexical search: exact inner products of sparse vectors, found through ball trees.

A document is the vector of what each term adds to a score, ``w * c`` with the term's weight w and its saturated, length-normed
count c; an item is the vector of its term counts, so a score is their inner product, exact in 64-bit integers.

1. One scan turns whole texts into sparse counts of the terms that the items ask for, staged; N, L and df are sums over these.
2. Each task takes its rows ``TREE`` at a time and splits them into a ball tree: a node keeps the sparse mean of its vectors and the
   radius around it, as a whole and term by term; two far vectors part a node.  An item walks the tree best-first by the bound
   ``<item, mean> + min(|item| * radius, <item, radius by term>)``, held against its 10th best score so far; leaves are scored exactly.
   (Documents share few of the terms of any one item, so the whole radius alone, which all items' terms swell, rarely prunes.)
   Bounds and radii are doubles that are widened by ``SAFE`` of all terms that entered them, thousands of times what rounding can
   lose, and only a bound strictly below the 10th score prunes, so ties are seen.  The best so far go on from tree to tree of a task.
3. A task hands on 10 rows per item at most; these are ranked by item, in two steps.

Items are a stated query set: they are read in blocks of ``ITEMS`` items or about ``VOCABULARY`` different terms, which is what
a task gets and holds, and each block is one scan of all documents.

Defined results: a null text has no terms; a document without any does not count in N; an item without terms, or whose
terms no document holds, gives no rows; rows of one item_id are one item, their terms together; a null doc_id is the smallest in ties
and comes back null; rows that share a doc_id are documents of their own; equal rows tie; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import id_back, id_key, map_batches, staged, table, texts

TOP = 10
ITEMS, VOCABULARY = 4_096, 200_000
TREE, LEAF = 8_192, 64
#: Share of the sum of all magnitudes by which bounds and squared radii are widened.
SAFE = 1e-9
#: Tasks that share the ranking of one item before its last step.
RANKERS = 64

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and whatever is not ASCII, A-Z as a-z."""
    return (text or "").encode().translate(_ASCII).split()


class Vectors:
    """Sparse rows: ``at[k] : at[k + 1]`` of ids and values (integers) belong to row k, whose document is ``key[k]``."""

    def __init__(self, key: np.ndarray, at: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.key, self.at, self.ids, self.values = key, at, ids, values

    def rows(self, chosen: np.ndarray) -> Vectors:
        size = self.at[chosen + 1] - self.at[chosen]
        at = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(at[-1]) + np.repeat(self.at[chosen] - at[:-1], size)
        return Vectors(self.key[chosen], at, self.ids[place], self.values[place])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """With each row; no row is empty."""
        return np.add.reduceat(self.values * dense[self.ids], self.at[:-1])

    def squares(self) -> np.ndarray:
        return np.add.reduceat(self.values.astype(float) ** 2, self.at[:-1])


class Node:
    """A ball: its sparse mean, radius, and two smaller balls or the vectors themselves."""

    def __init__(self, rows: Vectors, width: int, leaf: int):
        dense = np.bincount(rows.ids, rows.values, width) / len(rows.key)
        self.ids = np.flatnonzero(dense)
        self.mean, self.size = dense[self.ids], len(rows.key)
        squares, middle, cross = rows.squares(), float(self.mean @ self.mean), rows.dot(dense)
        gap = squares - 2 * cross + middle
        self.radius = math.sqrt(max(0.0, float(np.max(gap + SAFE * (squares + 2 * cross + middle)))))
        self.reach = math.sqrt(middle) + self.radius
        most = np.zeros(width)
        np.maximum.at(most, rows.ids, rows.values)
        self.above = most[self.ids] - self.mean
        self.rows, self.parts = rows, ()
        if self.size > leaf:
            near = self._split(rows, squares, gap, width)
            if near is not None:
                self.rows, self.parts = None, tuple(Node(rows.rows(np.flatnonzero(side)), width, leaf) for side in (near, ~near))

    @staticmethod
    def _split(rows: Vectors, squares: np.ndarray, gap: np.ndarray, width: int) -> np.ndarray | None:
        """Which rows are nearer to the row farthest from the mean than to the one farthest from that; None if all are alike."""
        apart = []
        at = int(np.argmax(gap))
        for _ in range(2):
            one = slice(rows.at[at], rows.at[at + 1])
            dense = np.zeros(width)
            dense[rows.ids[one]] = rows.values[one]
            apart.append(squares - 2 * rows.dot(dense) + squares[at])
            at = int(np.argmax(apart[0]))
        near = apart[0] <= apart[1]
        return near if near.any() and not near.all() else None

    def bound(self, item: np.ndarray, norm: float) -> float:
        """At least the score of every vector inside."""
        asked = item[self.ids]
        middle, above = float(asked @ self.mean), float(asked @ self.above)
        return middle + min(norm * self.radius, above) + SAFE * (middle + above + norm * self.reach)


def search(root: Node, item: np.ndarray, best: list[tuple[int, int]], top: int = TOP) -> int:
    """Best-first: puts (score, -key) of the ``top`` highest into the heap ``best``; gives the number of vectors scored."""
    norm, scored = math.sqrt(float(item @ item)), 0
    waiting = [(-root.bound(item, norm), 0, root)]
    order = 1
    while waiting:
        bound, _, node = heapq.heappop(waiting)
        if bound == 0 or (len(best) == top and -bound < best[0][0]):
            break
        if node.parts:
            for part in node.parts:
                heapq.heappush(waiting, (-part.bound(item, norm), order, part))
                order += 1
            continue
        scores = node.rows.dot(item)
        scored += len(scores)
        for k in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == top else 1)).tolist():
            entry = (int(scores[k]), -int(node.rows.key[k]))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
    return scored


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n (terms of the text), ids and tfs of the terms in ``vocabulary``, of every document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = known.value.get
        keys, sizes, ids, tfs, ends = [], [], [], [], [0]
        for key, text in zip(batch.column("key").to_pylist(), texts(batch)):
            words = terms(text)
            if words:
                tf = Counter(map(get, words))
                tf.pop(None, None)
                keys.append(key)
                sizes.append(len(words))
                ids.extend(tf)
                tfs.extend(tf.values())
                ends.append(len(ids))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["key", "n", "ids", "tfs"])

    return map_batches(docs.select(id_key().alias("key"), "text"), count, "key long, n long, ids array<int>, tfs array<int>")


def weights(n_docs: int, df: dict[int, int], size: int) -> np.ndarray:
    """Of each term, from the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)


def vectors_of(batch: pa.RecordBatch, weight: np.ndarray, n_docs: int, n_terms: int) -> Vectors:
    """The rows of a batch that hold a term of positive weight."""
    ids, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
    size = np.diff(batch.column("ids").offsets.to_numpy())
    m = np.array([25 + (75 * n * n_docs) // n_terms for n in batch.column("n").to_pylist()], np.int64)
    value = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
    row = np.repeat(np.arange(len(size)), size)[value > 0]
    held, count = np.unique(row, return_counts=True)
    return Vectors(batch.column("key").to_numpy()[held], np.concatenate(([0], np.cumsum(count))), ids[value > 0], value[value > 0])


def _together(parts: list[Vectors]) -> Vectors:
    return Vectors(np.concatenate([p.key for p in parts]), np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.at) for p in parts])))), np.concatenate([p.ids for p in parts]), np.concatenate([p.values for p in parts]))


def trees(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Node]:
    waiting: list[Vectors] = []
    for batch in batches:
        for k in range(0, batch.num_rows, TREE):
            rows = vectors_of(batch.slice(k, TREE), weight, n_docs, n_terms)
            if len(rows.key):
                waiting.append(rows)
            if sum(len(r.key) for r in waiting) >= TREE // 2:
                yield Node(_together(waiting), len(weight), LEAF)
                waiting = []
    if waiting:
        yield Node(_together(waiting), len(weight), LEAF)


def _ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key"))).where(F.col("rank") <= top)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, counts of its terms) in blocks of bounded size; a single item may hold more terms."""
    block: list[tuple[int | None, Counter]] = []
    seen: set[bytes] = set()
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        if block and block[-1][0] == row["item_id"]:
            block[-1][1].update(terms(row["text"]))
        else:
            if len(block) >= ITEMS or len(seen) >= VOCABULARY:
                yield block
                block, seen = [], set()
            block.append((row["item_id"], Counter(terms(row["text"]))))
        seen.update(block[-1][1])
    if block:
        yield block


def _block_hits(docs: DataFrame, block: list[tuple[int | None, Counter]], top: int) -> DataFrame | None:
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, counts in block for t in counts}))}
    rows = staged(counted(docs, vocabulary))
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None
    # At most a row for each term that the block asks for.
    df = dict(rows.select(F.explode("ids").alias("t")).groupBy("t").count().collect())
    asked = [([vocabulary[t] for t in counts], list(counts.values())) for _, counts in block]
    sent = docs.sparkSession.sparkContext.broadcast((weights(n_docs, df, len(vocabulary)), [i for i, _ in block], asked))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, names, asked = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in names]
        item = np.zeros(len(weight), np.int64)
        for root in trees(batches, weight, n_docs, n_terms):
            for heap, (ids, counts) in zip(best, asked):
                item[ids] = counts
                search(root, item, heap, top)
                item[ids] = 0
        out = [(name, -key, score) for name, heap in zip(names, best) for score, key in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, ["item_id", "key", "score"])

    found = rows.where(F.size("ids") > 0).mapInArrow(work, "item_id long, key long, score long")
    return _ranked(_ranked(found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RANKERS))), ["item_id", "part"], top), ["item_id"], top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` highest-scoring documents of each item."""
    hits = None
    for block in item_blocks(items):
        more = _block_hits(docs, block, top)
        hits = more if hits is None else hits if more is None else hits.unionByName(more)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return hits.select("item_id", "rank", id_back("key").alias("doc_id"), "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

QUERIES = {"op12_lexical": op12_lexical}
SQL = {
    "op12_lexical": f"""with asked as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
words as (select row_number() over () as row, doc_id, {_TERMS} as ws from documents), sized as (select row, doc_id, len(ws)::bigint as n from words where len(ws) > 0),
counts as (select row, term, count(*) as tf from (select row, unnest(ws) as term from words) where term in (select term from asked) group by 1, 2),
totals as (select count(*)::bigint as docs, sum(n)::bigint as all_terms from sized),
weighted as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*) as df from counts group by 1), totals),
scores as (select item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // all_terms))))::bigint as score
  from asked join counts using (term) join weighted using (term) join sized using (row), totals group by 1, 2, 3),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""
}
