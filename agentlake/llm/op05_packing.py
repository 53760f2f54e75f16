"""Packing: best-fit decreasing into windows of a fixed number of tokens.

Documents are encoded whole and end with an end id.  Overlong ones are first cut into full windows; what
is left of each document goes, longest first, into the open window with the tightest room, found by a
segment tree over remaining capacities.  Every partition packs its own documents as it reads them, so
nothing is shuffled; the windows that a partition could not fill well are opened again and their pieces
packed once more, in buckets of about ``BUCKET`` pieces from all partitions.  A bucket is drawn by a
number that each loose piece got in the first pass, so rows that share an id or have none spread as well.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; an
empty table gives no rows; other columns are not read.  Which pieces share a sequence follows from how the
table lies in partitions: another layout gives other sequences, packed as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged, table, texts
from .tokens import DEFAULT_VOCABULARY, encoder, vocabulary_path

WINDOW, END_ID = 2048, 1
#: Pieces that are packed together: at most so many in one partition's pass, about so many in a bucket.
PASS, BUCKET = 200_000, 4_000
#: A partition keeps a window with at most so many tokens of padding.
TIGHT = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


class OpenWindows:
    """Counts of open windows by remaining capacity, in a segment tree."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._tree = [0] * (2 * self._leaves)

    def add(self, room: int, n: int = 1) -> None:
        at = self._leaves + room
        while at:
            self._tree[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of an open window that is at least ``length``."""
        tree, at = self._tree, self._leaves + length
        while not tree[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self._leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        return at - self._leaves


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of ``lengths`` by window; ties keep their order."""
    open_, by_room, windows = OpenWindows(capacity), {}, []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = open_.tightest(lengths[k])
        if room is None:
            w, room = len(windows), capacity
            windows.append([])
        else:
            w = by_room[room].pop()
            open_.add(room, -1)
        windows[w].append(k)
        if room > lengths[k]:
            by_room.setdefault(room - lengths[k], []).append(w)
            open_.add(room - lengths[k])
    return windows


def _packed(pieces: list[tuple], capacity: int, first: int, tight: int | None) -> Iterator[tuple]:
    """Pieces with sequence and offset; in windows that have over ``tight`` tokens left, without a sequence and with a number of their own."""
    loose = first
    for window in best_fit_decreasing([p[2] for p in pieces], capacity):
        at = 0
        kept = tight is None or capacity - sum(pieces[k][2] for k in window) <= tight
        for k in window:
            yield (*pieces[k], first if kept else None, at if kept else loose)
            at += pieces[k][2]
            loose += 1
        first += kept


def pack(docs: DataFrame, capacity: int = WINDOW, end_id: int = END_ID, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, end = vocabulary_path(vocabulary), end_id.to_bytes(4, "little")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        enc = encoder(path)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], _NAMES)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, waiting
            if waiting:
                found = list(_packed(waiting, capacity, sequence, TIGHT))
                sequence += len(waiting)
                waiting = []
                yield rows(found)

        for batch in batches:
            full: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    piece = (doc_id, start, len(part) // 4, zlib.crc32(part), n)
                    if piece[2] == capacity:
                        full.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        waiting.append(piece)
            if full:
                yield rows(full)
            if len(waiting) >= PASS:
                yield from flush()
        yield from flush()

    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first_pass, PIECES))
    left = pieces.where("sequence_id is null")
    buckets = left.count() // BUCKET + 1

    def second_pass(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first = (1 << 62) + (int(key[0]) << 24)
        group = group.sort_values(["doc_id", "start", "ids_crc32"])
        found = [(None if p[0] is pd.NA else p[0], *p[1:]) for p in group[_NAMES[:5]].astype("Int64").itertuples(index=False, name=None)]
        return pd.DataFrame(_packed(found, capacity, first, None), columns=_NAMES).astype("Int64")

    again = left.withColumn("bucket", F.pmod(F.xxhash64("offset"), F.lit(buckets))).groupBy("bucket").applyInPandas(second_pass, PIECES)
    return pieces.where("sequence_id is not null").unionByName(again)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
