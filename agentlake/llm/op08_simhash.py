r"""SimHash near-dedup: 64-bit fingerprints of 4-word shingles, linked within a radius, compared exactly in tiles.

Equal fingerprints are one from the start.  A pair that differs in at most r bits agrees in at least
m - r of m blocks of bits, so for each choice of m - r blocks the fingerprints that share those bits form
a bucket, and no pair within the radius is missed.  Inside a bucket the fingerprints are sorted by
population count and cut into tiles; tile pairs whose counts differ beyond the radius are skipped, the
others compared whole by numpy exclusive-or and bit counts.  More blocks make more and finer buckets;
their number follows the number of fingerprints.  A bucket above ``SPLIT`` is cut into parts, and each
pair of parts is a task of its own.  A bucket hands on a forest of its links, not the pairs, and
components are found by star contraction.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; fewer than
four words are one shingle; repeated rows and equal fingerprints share a component; a null doc_id counts
as the smallest id and comes back null; an empty table gives no rows; other columns are not read by
``simhash`` and are kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import id_back, id_key, map_batches, staged, table, texts
from .components import components, local_roots

SHINGLE, SEED, RADIUS = 4, 42, 4
TILE, SPLIT = 512, 8_192
#: Hashes whose bits are counted at once.
BLOCK = 65_536


def fingerprint(text: str) -> int:
    import xxhash

    joined = b" ".join(text.encode().lower().split())  # bytes: only A-Z, only ASCII white space
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    if len(starts) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        part = zip(starts[k : k + BLOCK], ends[k : k + BLOCK])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """key (doc_id, null as the smallest) and fp, a signed 64-bit number; and ``more``, columns of longs."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps), *(batch.column(n) for n in names)], ["key", "fp", *names])

    chosen = docs.select(id_key().alias("key"), "text", *more)
    names = chosen.columns[2:]
    return map_batches(chosen, rows, ", ".join(f"{n} long" for n in ["key", "fp", *names]))


def block_masks(blocks: int, radius: int) -> list[int]:
    """For each choice of ``blocks - radius`` blocks of bits, their mask as a signed number."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(choice)) for choice in combinations(own, blocks - radius)]


def near_links(fps: np.ndarray, radius: int, part: np.ndarray | None = None, tile: int = TILE) -> np.ndarray:
    """The local root of each fingerprint over the pairs within ``radius``; with ``part``, over pairs of two parts only."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    sorted_, ones = fps[order], np.bitwise_count(fps[order]).astype(int)
    parts = None if part is None else part[order]
    roots = np.arange(len(fps))
    for a in range(0, len(fps), tile):
        for b in range(a, len(fps), tile):
            if ones[b] - ones[min(a + tile, len(fps)) - 1] > radius:
                break  # later tiles have still more ones
            near = np.bitwise_count(sorted_[a : a + tile, None] ^ sorted_[None, b : b + tile]) <= radius
            if parts is not None:
                near &= parts[a : a + tile, None] != parts[None, b : b + tile]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            roots = local_roots(len(fps), i[i != j], j[i != j], roots)
    out = np.empty_like(roots)
    out[order] = order[roots]
    return out


def _bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; each bucket's links go out as edges to its roots."""
    names, rest = ["bucket", "block", "i", "j"], None

    def edges(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        cut = np.flatnonzero(np.any([columns[n][1:] != columns[n][:-1] for n in names], axis=0)) + 1
        found = []
        for fps, i, j, part in zip(*(np.split(columns[n], cut) for n in ("fp", "i", "j", "part"))):
            if len(fps) > 1:
                roots = near_links(fps.view(np.uint64), radius, part if i[0] != j[0] else None)
                at = np.flatnonzero(roots != np.arange(len(fps)))
                found.append((fps[at], fps[roots[at]]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if rest is not None:
            columns = {n: np.concatenate([rest[n], c]) for n, c in columns.items()}
        last = np.all([columns[n] == columns[n][-1] for n in names], axis=0) if len(columns["fp"]) else np.empty(0, bool)
        begin = len(last) - int(np.argmin(last[::-1])) if len(last) and not last.all() else 0
        rest = {n: c[begin:] for n, c in columns.items()}
        if begin:
            yield edges({n: c[:begin] for n, c in columns.items()})
    if rest is not None and len(rest["fp"]):
        yield edges(rest)


def blocks_for(n: int, radius: int) -> int:
    """Blocks such that buckets of ``n`` evenly spread fingerprints hold a few thousand at most."""
    blocks = radius + 1
    while n >> (64 * (blocks - radius) // blocks) > 2_048:
        blocks += 1
    return blocks


def near_edges(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) between fingerprints that connect just what pairs within ``radius`` connect."""
    masks = block_masks(blocks or blocks_for(distinct.count(), radius), radius)
    keyed = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bucket")) for k, m in enumerate(masks))))
    rows = distinct.select("fp", keyed.alias("k")).select("fp", "k.block", "k.bucket")
    large = staged(rows.groupBy("block", "bucket").count().where(F.col("count") > split).select("block", "bucket", F.ceil(F.col("count") / split).cast("int").alias("parts")))
    parted = rows.join(large, ["block", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = pairs.select("block", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    keys = ["block", "bucket", "i", "j"]
    return tasks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _bucket_edges(batches, radius), "a long, b long")


def rooted(rows: DataFrame, radius: int = RADIUS, first: Column | None = None) -> DataFrame:
    """Of each fp in ``rows``: fp, first (the smallest key, or another aggregate) and root, the fingerprint that names its component."""
    classes = staged(rows.groupBy("fp").agg((F.min("key") if first is None else first).alias("first")))
    found = components(near_edges(classes.select("fp"), radius))
    return classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def simhash(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = staged(fingerprints(docs))
    joined = rooted(rows, radius)
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    labels = joined.join(smallest, "root").select("fp", "component")
    return rows.join(labels, "fp").select(
        id_back("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), id_back("component").alias("component_id")
    )


def row_digest(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row; nulls count, and what has no hash of its own is taken as JSON."""
    plain = [F.to_json(F.struct(c)) if any(k in t for k in ("map<", "variant")) else F.col(c) for c, t in docs.dtypes]
    parts = [x for c, p in zip(docs.columns, plain) for x in (F.col(c).isNull(), p)]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"digest{seed}") for seed in (0, 1)]


def drop_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, the first row by (doc_id, digest of the row).

    Components are told apart by their root fingerprint, as rows of unlike texts may share a doc_id.  The first row of each
    fingerprint is found before the shuffle, so that a component of very many copies is a row per task and fingerprint.
    """
    names, digest = ["key", "digest0", "digest1"], row_digest(docs)
    rows = staged(fingerprints(docs, *digest))
    first = rooted(rows, radius, F.min(F.struct(*names))).groupBy("root").agg(F.min("first").alias("first"))
    # Equal rows have one root, so the join's partitions and order by (key, digests) serve to drop what is twice: rows are shuffled and sorted once.
    keep = first.select("first.*").hint("merge")
    found = docs.select(id_key().alias("key"), *digest, F.struct(*docs.columns).alias("row")).join(keep, names)
    return found.dropDuplicates(names).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
