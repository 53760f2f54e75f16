"""Embedding near-dedup: tiles of vectors compared in the order of principal components.

Cosine is taken in double precision between vectors of one label (and length).  Equal vectors are one
from the start.  The axes of all unit vectors, by falling variance, come from their second moments, summed
up in tasks.  For unit vectors a cosine of t means a distance of sqrt(2 - 2t).

Vectors are ordered by cells along the leading axes (``GRID`` of them, Z-order; a cell is narrower than
that distance at the thresholds that count) and cut into tiles of ``TILE`` vectors or little more; a cell
with more than that is dealt out evenly, as no two places in it are far enough apart on these axes to
matter.  Of each tile the ranges along ``LEAD`` axes and of the norm of what is left of its vectors are
kept, and pairs of tiles whose ranges are further apart than the distance are skipped.  Each other pair is
a task; tiles travel as blocks of vectors.  There, products are summed over the leading axes first; with the norms of
what is left of two vectors as a bound, pairs that can't reach t any more are dropped after each step, and
the few that stay get their exact cosine from the vectors as they were given.  A task hands on how many
links each vector has, and a forest of them.

A vector goes to as many tasks as there are tiles near its own, so where a label's vectors lie in one
cloud that no axis parts, work grows with the square of the label and the shuffle with square by ``TILE``.

Defined results: a vector without a label, null, empty, zero, or with a null or non-finite component links
with nothing and is its own component; vectors of any finite size, however large or small, are compared;
equal vectors of one label link with each other; a null vec_id counts as the smallest id and comes back
null; repeated rows are vectors of their own, and rows that share a vec_id share its component; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import id_back, id_key, map_batches, staged, table
from .components import components, local_roots

THRESHOLD = 0.93
TILE, ROWS, LEAD = 16_384, 256, 16
#: Axes of the grid, and bits of a cell along each; bytes of a travelling block of vectors.
GRID, BITS, BLOCK = 3, 4, 8_192
#: Slack of the bounds, far above rounding and below any margin that counts.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(len(lists), -1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component is near 1: nothing overflows, and cosines stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the axes of the unit vectors, by falling variance.  To the driver come length squared numbers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("embedding")))
            for size in np.unique(sizes):
                u = _unit(_matrix(batch.column("embedding").filter(pa.array(sizes == size))))
                u = np.hstack([u, np.ones((len(u), 1))])
                sums[size] = sums.get(size, 0) + u.T @ u
        for size, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(size)] * s.size, pa.int32()), pa.array(np.arange(s.size, dtype=np.int32)), pa.array(s.ravel())], ["size", "at", "value"])

    found: dict[int, dict[int, float]] = {}
    for r in vectors.select("embedding").mapInArrow(moments, "size int, at int, value double").groupBy("size", "at").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["size"], {})[r["at"]] = r["value"]
    axes = {}
    for size, values in found.items():
        s = np.array([values[k] for k in range((size + 1) ** 2)]).reshape(size + 1, size + 1)
        mean = s[-1, :-1] / s[-1, -1]
        axes[size] = np.linalg.eigh(s[:-1, :-1] / s[-1, -1] - np.outer(mean, mean))[1][:, ::-1]
    return axes


def cells(turned: np.ndarray) -> np.ndarray:
    """The Z-order number of each row's cell along the first ``GRID`` axes."""
    out = np.zeros(len(turned), np.int64)
    for axis in range(min(GRID, turned.shape[1])):
        place = np.clip((turned[:, axis] + 1) * 2 ** (BITS - 1), 0, 2**BITS - 1).astype(np.int64)
        for bit in range(BITS):
            out |= (place >> bit & 1) << (bit * GRID + axis)
    return out


def tile_links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``a``, row of ``b``) with a cosine of at least ``threshold``; without ``b`` of ``a`` with itself, each pair once."""
    left = _scaled(a)
    right = left if b is None else _scaled(b)
    norms = [np.linalg.norm(x, axis=1) for x in (left, right)]
    turned = [(x / n[:, None]) @ axes for x, n in zip((left, right), norms)]
    size = axes.shape[0]
    steps = [*range(0, size, LEAD), size]
    rest = [{s: np.sqrt((t[:, s:] ** 2).sum(1)) for s in steps} for t in turned]
    first = steps[1]
    for at in range(0, len(left), ROWS):
        begin = at if b is None else 0
        sums = turned[0][at : at + ROWS, :first] @ turned[1][begin:, :first].T
        i, j = np.nonzero(sums + np.outer(rest[0][first][at : at + ROWS], rest[1][first][begin:]) >= threshold - SLACK)
        so_far, i, j = sums[i, j], i + at, j + begin
        if b is None:
            keep = i < j
            so_far, i, j = so_far[keep], i[keep], j[keep]
        for s, e in zip(steps[1:], steps[2:]):
            so_far = so_far + np.einsum("ij,ij->i", turned[0][i, s:e], turned[1][j, s:e])
            keep = so_far + rest[0][e][i] * rest[1][e][j] >= threshold - SLACK
            so_far, i, j = so_far[keep], i[keep], j[keep]
        exact = np.einsum("ij,ij->i", left[i], right[j]) / (norms[0][i] * norms[1][j])
        yield i[exact >= threshold], j[exact >= threshold]


def _packed(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile.  Out: blocks of vectors, with their range along the leading axes and of the norm that is left."""
    names = ["tile", "label", "size", "node", "n", "block", "low", "high"]
    for batch in batches:
        tile, node, n = (batch.column(c).to_numpy() for c in ("tile", "node", "n"))
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        spans = []
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                rows = max(1, BLOCK // (8 * batch.column("size")[a].as_py()))
                spans += [(k, min(k + rows, b)) for k in range(a, b, rows)]
        out: list[list] = [[] for _ in range(5)]
        for a, b in spans:
            vectors = _matrix(batch.column("embedding").slice(a, b - a))
            turned = _unit(vectors) @ axes[vectors.shape[1]]
            left = np.sqrt((turned[:, LEAD:] ** 2).sum(1, keepdims=True))
            marks = np.hstack([turned[:, :LEAD], left])
            for column, value in zip(out, (node[a:b], n[a:b], vectors.tobytes(), marks.min(0), marks.max(0))):
                column.append(value)
        at = pa.array([a for a, _ in spans], pa.int32())
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names[:3]), *(pa.array(c, k) for c, k in zip(out, kinds))], names)


def _tile_rows(batches: Iterator[pa.RecordBatch], axes: dict[int, np.ndarray], threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks come sorted by task (i, j).  Out: node, the links it has here, its root here."""
    waiting: list[tuple] = []

    def side(own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        rows = [r for r in waiting if r[2] == own]
        size = rows[0][3]
        return tuple(np.concatenate(x) for x in ([r[4] for r in rows], [r[5] for r in rows], [np.frombuffer(r[6]).reshape(-1, size) for r in rows]))

    def work() -> Iterator[pa.RecordBatch]:
        i_tile, j_tile, _, size = waiting[0][:4]
        node, n, vectors = side(i_tile)
        node_b, n_b, vectors_b = (node, n, None) if i_tile == j_tile else side(j_tile)
        shift = 0 if i_tile == j_tile else len(node)
        nodes, ns = (node, n) if not shift else (np.concatenate([node, node_b]), np.concatenate([n, n_b]))
        links, roots = np.zeros(len(nodes)), np.arange(len(nodes))
        for i, j in tile_links(vectors, vectors_b, axes[size], threshold):
            j = j + shift
            links += np.bincount(i, ns[j], len(nodes)) + np.bincount(j, ns[i], len(nodes))
            roots = local_roots(len(nodes), i, j, roots)
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(links[at].astype(np.int64)), pa.array(nodes[roots[at]])], ["node", "links", "root"])

    for batch in batches:
        columns = [batch.column(c) for c in ("i", "j", "tile", "size", "node", "n", "block")]
        for i, j, tile, size, node, n, block in zip(*columns):
            row = (i.as_py(), j.as_py(), tile.as_py(), size.as_py(), node.values.to_numpy(), n.values.to_numpy(), block.as_py())
            if waiting and waiting[0][:2] != row[:2]:
                yield from work()
                waiting.clear()
            waiting.append(row)
    if waiting:
        yield from work()


def tile_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """(tile, i, j): each tile with each task it is in; tiles whose ranges are further apart than ``reach`` have none."""
    merged = lambda f, c: F.array(*(f(F.get(c, F.lit(k))) for k in range(LEAD + 1)))
    ranges = staged(blocks.groupBy("tile").agg(F.first("label").alias("label"), F.first("size").alias("size"), merged(F.min, "low").alias("low"), merged(F.max, "high").alias("high")))
    bucket = lambda x: F.floor(x / reach)
    side = lambda n, wide: ranges.select("label", "size", *(F.col(c).alias(f"{c}_{n}") for c in ("tile", "low", "high")), bucket(F.col("low")[0] - wide).alias(f"from_{n}"), F.explode(F.sequence(bucket(F.col("low")[0] - wide), bucket(F.col("high")[0] + wide))).alias("at"))
    gap = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(F.filter(gap, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x * x)
    near = side("a", 0.0).join(side("b", reach), ["label", "size", "at"]).where((F.col("tile_a") <= F.col("tile_b")) & (F.col("at") == F.greatest("from_a", "from_b")) & (apart <= (reach + SLACK) ** 2))
    pairs = near.select(F.col("tile_a").alias("i"), F.col("tile_b").alias("j"))
    return pairs.select(F.col("i").alias("tile"), "i", "j").unionByName(pairs.where("i <> j").select(F.col("j").alias("tile"), "i", "j"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    digest = [F.xxhash64(F.lit(seed), "label", "embedding").alias(f"digest{seed}") for seed in (0, 1)]
    rows = vectors.select(id_key("vec_id").alias("key"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    classes = staged(rows.where(good).groupBy("label", "embedding").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("size", F.size("embedding")))
    axes = principal_axes(classes)
    if not axes:
        return rows.select(id_back("key").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), id_back("key").alias("component_id"), F.lit(True).alias("kept"))

    def with_cell(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, cell = batch.column("size").to_numpy(), np.zeros(batch.num_rows, np.int64)
        for s in np.unique(size):
            own = size == s
            cell[own] = cells(_unit(_matrix(batch.column("embedding").filter(pa.array(own)))) @ axes[s][:, :GRID])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    celled = map_batches(classes, with_cell, ", ".join(f"{n} {t}" for n, t in [*classes.dtypes, ("cell", "long")]))
    # Cells in order until a tile is full; a cell above that has tiles of its own.
    before = F.sum("count").over(Window.partitionBy("label", "size").orderBy("cell")) - F.col("count")
    large = F.col("count") > tile
    tiles = staged(celled.groupBy("label", "size", "cell").count().withColumn("base", F.when(large, -1 - F.col("cell")).otherwise(F.floor(before / tile))).withColumn("parts", F.ceil(F.col("count") / tile)).drop("count"))
    tiled = celled.join(tiles, ["label", "size", "cell"]).withColumn("tile", F.xxhash64("label", "size", "base", F.pmod(F.xxhash64("node"), F.col("parts"))))
    sorted_ = tiled.select("tile", "label", "size", "node", "n", "embedding").repartition("tile").sortWithinPartitions("tile")
    label = dict(classes.dtypes)["label"]
    blocks = staged(sorted_.mapInArrow(lambda b: _packed(b, axes), f"tile long, label {label}, size int, node array<long>, n array<long>, block binary, low array<double>, high array<double>"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    dealt = blocks.join(tile_pairs(blocks, reach), "tile").select("i", "j", "tile", "size", "node", "n", "block")
    found = staged(dealt.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(lambda b: _tile_rows(b, axes, threshold), "node long, links long, root long"))

    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "component")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        classes.select("node", "n", *digest).join(links, "node", "left").join(roots, "node", "left")
        .select("digest0", "digest1", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    # Two hashes stand for label and vector, so that no vector is shuffled; a very common one is split by AQE.
    joined = rows.select("key", F.when(good, digest[0]).alias("digest0"), F.when(good, digest[1]).alias("digest1")).join(known, ["digest0", "digest1"], "left")
    return joined.select(
        id_back("key").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), id_back(F.coalesce("component", "key")).alias("component_id"),
        (F.coalesce("component", "key") == F.col("key")).alias("kept"),
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embeddings": op3_embeddings}
SQL = {
    "op3_embeddings": """
with recursive good as (
  select vec_id, label, embedding::double[] as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm
  from embeddings
  where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links as materialized (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reached as (
  select vec_id as node, vec_id as root from embeddings
  union
  select links.b, reached.root from reached join links on links.a = reached.node
), roots as (
  select node, min(root) as root from reached group by node
), counts as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, vec_id = root as kept
from embeddings join roots on node = vec_id left join counts on a = vec_id""",
}
