"""Suffix-array dedup: every repeat of a 100-byte string goes, found by a depth-limited radix sort.

Exact but for one chance: whole blocks of different tasks (step 1) count as equal by two 64-bit hashes and not by their bytes, so two
different blocks are taken for one with a probability below 2^-56 for each pair that shares a digit.  Elsewhere bytes decide.

Suffixes are told apart only through ``window`` bytes, digit by digit, and leave as soon as they are alone
in their bucket; groups that are still equal at full depth are exactly the repeated windows.

1. The first digit of a window is its lowest-hashed string of ``gram`` bytes, at whatever place, leftmost on
   ties: equal windows have equal digits, and neighbouring windows share theirs, so a run of windows with
   one digit, a block of about 33, is one record and not 33.  (With the leading bytes as first digit
   each byte of the corpus would be a record.)  A digit with one block only has no repeats, and leaves.
   All but the first of blocks that are equal in all bytes are repeats, whole.  What is left, a few
   hundredths of all windows, are the windows of blocks that share a digit and differ.
2. These travel with their bytes, by digit, and the windows of a digit are sorted most significant bytes
   first, eight at a time; a pass goes on only in buckets of two or more.  Bytes decide.

Hot digits: before each shuffle a task drops the repeats it holds itself, so a passage in very many
documents is one record per task and chunk.  A digit with ``HOT`` different blocks in one task sends them
straight to the second step and only a notice to its group; there the windows of such digits, and of
digits with over ``GROUP`` blocks, go by all their bytes instead, one by one, so that no task gathers what a
large share of the corpus has in common.

Defined results: a null text is empty; matches never cross documents; a null doc_id counts as the smallest
and comes back null; rows that share a doc_id are documents of their own, in the order of a hash of their
texts, and those that share the text too count as one; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import id_back, id_key, staged, table, texts

WINDOW, GRAM = 100, 36
#: Bytes worked on at once; different blocks of one digit in a task, and blocks in its group, that make it hot.
CHUNK, HOT, GROUP = 1 << 20, 16, 20_000
#: Slots in which a task counts the blocks of its digits; digits that share one are hot sooner.
SLOTS = 1 << 23
#: Windows that are sorted at once.
SORTED = 200_000
BLOCK, GONE, RIM, NOTICE = range(4)

_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(0, 2**64, 256, np.uint64)
_ODD = _RNG.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of all strings of a length in a buffer, from those of doubled lengths."""

    def __init__(self, raw: np.ndarray, longest: int):
        self._n, self._levels = len(raw), [_BYTES[raw]]
        for k in range(longest.bit_length() - 1):
            h, half = self._levels[-1], 1 << k
            self._levels.append(h[:-half] * _ODD[k] + h[half:])

    def of(self, length: int) -> np.ndarray:
        out, at, count = None, 0, self._n - length + 1
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                part = self._levels[k][at : at + count]
                out = part if out is None else out * _ODD[8] + part
                at += 1 << k
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    n = len(x) - width + 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:n], x[width - span : width - span + n])


def blocks(raw: np.ndarray, valid: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """first start, number of windows, digit and digest of each block; ``valid``: the starts that count."""
    longest = 1 << (window.bit_length() - 1)
    hashes = _Hashes(raw, longest)
    digit = _mixed(hashes.of(gram))
    place = np.arange(len(digit), dtype=np.uint64)
    anchor = (_sliding_min((digit & np.uint64(0xFFFFFFFF00000000)) | place, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(valid[: len(anchor)])
    if not len(at):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchor[at]) != 0))))
    first, n = at[new], np.diff(np.append(new, len(at)))
    length = n + window - 1
    # The longest strings of a doubled length, at the block's begin, middle and end, cover it.
    h = hashes.of(longest)
    digest = length.astype(np.uint64)
    for start in (first, first + (length - longest) // 2, first + length - longest):
        digest = _mixed(digest * _ODD[9] + h[start])
    return first, n, digit[anchor[first]], digest


def _ranks(keys: list[int], subs: list[int]) -> np.ndarray:
    """The place of each (key, sub) in their order; equal ones share it."""
    at = {pair: k for k, pair in enumerate(sorted({*zip(keys, subs)}))}
    return np.array([at[pair] for pair in zip(keys, subs)], np.int64)


def _pieces(ranks: np.ndarray, rows: list[bytes], window: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Lists of (row, bytes, offset in the document), in the order of ranks, of about ``CHUNK`` bytes."""
    waiting, size = [], 0
    for k in np.argsort(ranks, kind="stable").tolist():
        for a in range(0, max(1, len(rows[k]) - window + 1), CHUNK):
            piece = rows[k][a : a + CHUNK + window - 1]
            if len(piece) >= window:
                waiting.append((k, piece, a))
                size += len(piece)
            if size >= CHUNK:
                yield waiting
                waiting, size = [], 0
    if waiting:
        yield waiting


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of overlapping or touching spans."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    change = key[1:] != key[:-1]
    apart = np.concatenate(([0], np.cumsum(change))) << 40  # texts are shorter
    reach = np.maximum.accumulate(end + apart)
    at = np.flatnonzero(np.concatenate(([True], change | ((start + apart)[1:] > reach[:-1]))))
    return key[at], start[at], np.maximum.reduceat(end, at)


def _leads(groups: tuple[np.ndarray, ...], rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row, the row of the smallest (rank, start) with equal values in all of ``groups``."""
    order = np.lexsort((start, rank, *groups))
    new = np.concatenate(([True], np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)))
    out = np.empty(len(rank), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings of ``length`` bytes at ``a`` and ``b`` are equal."""
    out = np.empty(len(a), bool)
    for k in range(0, len(a), 4_000):
        n = length[k : k + 4_000]
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(begin, n)
        out[k : k + 4_000] = np.logical_and.reduceat(raw[np.repeat(a[k : k + 4_000], n) + at] == raw[np.repeat(b[k : k + 4_000], n) + at], begin)
    return out


def _signed(x) -> pa.Array:
    x = np.asarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _found(p, digest, key, sub, start, n, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(_signed, (p, digest, key, sub, start)), pa.array(np.asarray(n, np.int32)), pa.array(np.asarray(kind, np.int32))], ["p", "digest", "key", "sub", "start", "n", "kind"])


_FOUND = "p long, digest long, key long, sub long, start long, n int, kind int"


def _scan(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The blocks of whole texts: BLOCK rows, GONE spans (digest: their end), RIM blocks of hot digits, NOTICE of these."""
    tally, seen = np.zeros(SLOTS, np.uint8), np.zeros(SLOTS, bool)
    slot = lambda x: (x & np.uint64(SLOTS - 1)).astype(np.int64)
    for batch in batches:
        keys, subs, rows = batch.column("key").to_pylist(), batch.column("sub").to_pylist(), [t.encode() for t in texts(batch)]
        ranks = _ranks(keys, subs)
        key_of, sub_of = np.array(keys, np.int64), np.array(subs, np.int64)
        for pieces in _pieces(ranks, rows, window):
            raw = np.frombuffer(b"".join(x for _, x, _ in pieces), np.uint8)
            ends = np.cumsum([len(x) for _, x, _ in pieces])
            begins = np.concatenate(([0], ends[:-1]))
            valid = np.ones(len(raw), bool)
            for e in ends:
                valid[max(0, e - window + 1) : e] = False
            first, n, digit, digest = blocks(raw, valid, window, gram)
            if not len(first):
                continue
            piece = np.searchsorted(ends, first, "right")
            row = np.array([k for k, _, _ in pieces])[piece]
            start = first - begins[piece] + np.array([a for _, _, a in pieces])[piece]
            rank = ranks[row]
            lead = _leads((digest, digit), rank, start)
            gone = (rank != rank[lead]) | (start != start[lead])
            at = np.flatnonzero(gone)
            gone[at] = _same_bytes(raw, first[at], first[lead[at]], n[at] + window - 1) if len(at) else False
            owner, begin, end = _merged(row[gone], start[gone], (start + n + window - 1)[gone])
            yield _found(_mixed(key_of[owner].view(np.uint64) * _ODD[10] + begin.astype(np.uint64)), end, key_of[owner], sub_of[owner], begin, np.zeros(len(owner)), np.full(len(owner), GONE))
            row, start, n, digit, digest = (x[~gone] for x in (row, start, n, digit, digest))
            own = slot(digit ^ (digest * _ODD[11]))
            slots, more = np.unique(slot(digit)[~seen[own]], return_counts=True)
            seen[own] = True
            tally[slots] = np.minimum(tally[slots] + more, 255)
            hot = tally[slot(digit)] >= HOT
            yield _found(np.where(hot, digest, digit), digest, key_of[row], sub_of[row], start, n, np.where(hot, RIM, BLOCK))
            notice = np.unique(digit[hot])
            none = np.zeros(len(notice))
            yield _found(notice, none, none, none, none, none, none + NOTICE)


def _block_pass(blocks_: DataFrame, window: int) -> DataFrame:
    """(key, sub, start, end, n, rim, p): spans that repeat, and blocks (rim) whose digit has blocks that differ; p, the digit, is null for hot ones."""
    digit, same = Window.partitionBy("p"), Window.partitionBy("p", "digest").orderBy("key", "sub", "start")
    about = {"low": F.min("digest").over(digit), "high": F.max("digest").over(digit), "worst": F.max("kind").over(digit), "size": F.count(F.lit(1)).over(digit)}
    ranked = blocks_.repartition("p").withColumn("nth", F.rank().over(same)).withColumns(about)
    repeat = (F.col("kind") == BLOCK) & (F.col("nth") > 1)
    rim = (F.col("kind") == RIM) | ((F.col("kind") == BLOCK) & (F.col("nth") == 1) & ((F.col("low") < F.col("high")) | (F.col("worst") == NOTICE)))
    hot = (F.col("kind") == RIM) | (F.col("worst") == NOTICE) | (F.col("size") > GROUP)
    end = F.when(F.col("kind") == GONE, F.col("digest")).otherwise(F.col("start") + F.col("n") + (window - 1))
    return staged(ranked.where(repeat | rim | (F.col("kind") == GONE)).select("key", "sub", "start", end.alias("end"), "n", rim.alias("rim"), F.when(~hot, F.col("p")).alias("p")))


_SUFFIXES = "p long, key long, sub long, start long, n int, bytes binary"
_SUFFIX_NAMES = [c.split()[0] for c in _SUFFIXES.split(", ")]


def _suffix_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _SUFFIX_NAMES)


def _suffixes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The bytes of rim blocks, with their digit; windows of hot digits one by one, with a hash of them, each once per batch.

    What a batch holds twice already goes on as a span without bytes.
    """
    import xxhash

    single: dict[bytes, tuple[int, int, int]] = {}
    out: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        out.extend((xxhash.xxh3_64_intdigest(w) - 2**63, *at, 1, w) for w, at in single.items())
        single.clear()
        if out:
            yield _suffix_rows(out)
        out.clear()

    for batch in batches:
        for key, sub, text, rims in zip(batch.column("key").to_pylist(), batch.column("sub").to_pylist(), texts(batch), batch.column("rims").to_pylist()):
            raw = text.encode()
            for r in rims:
                start, n = r["start"], min(r["n"], len(raw) - window + 1 - r["start"])
                if r["p"] is not None:
                    out.append((r["p"], key, sub, start, n, raw[start : start + n + window - 1]))
                    continue
                for s in range(start, start + n):
                    w, own = raw[s : s + window], (key, sub, s)
                    known = single.setdefault(w, own)
                    if known != own:
                        single[w] = min(known, own)
                        k, b, a = max(known, own)
                        out.append((a * 2654435761 ^ k, k, b, a, 1, None))
            if len(out) + len(single) > SORTED // 4:
                yield from flush()
    yield from flush()


def repeated_windows(raw: np.ndarray, at: np.ndarray, group: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each of ``at`` equals one of its group with a smaller (rank, start).

    Most significant digit first: a pass sorts by eight more bytes what is still together, and lets go what has become single.
    """
    out = np.zeros(len(at), bool)
    live, bucket = np.arange(len(at)), group
    width = min(8, window)
    for d in [*range(0, window - width, width), window - width]:
        digit = raw[at[live][:, None] + np.arange(d, d + width)]
        digit = np.pad(digit, ((0, 0), (0, 8 - width))).view(">u8").ravel()
        order = np.lexsort((digit, bucket))
        b, x = bucket[order], digit[order]
        run = np.cumsum(np.concatenate(([True], (b[1:] != b[:-1]) | (x[1:] != x[:-1])))) - 1 if len(b) else b
        several = np.bincount(run, minlength=1)[run] > 1
        live, bucket = live[order][several], run[several]
        if not len(live):
            return out
    lead = live[_leads((bucket,), rank[live], start[live])]
    out[live] = (rank[live] != rank[lead]) | (start[live] != start[lead])
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Suffix rows come sorted by p, key, sub and start.  Out: (key, sub, start, end) of windows that repeat an earlier one of their p.

    Of a group too large to be held, what is left of its begin goes on with what follows, window by window.
    """
    waiting: list[tuple] = []
    held, least = 0, SORTED

    def work(rows: list[tuple]) -> tuple[pa.RecordBatch, list[tuple]]:
        p, key, sub, start, n = (np.array(c, np.int64) for c in list(zip(*rows))[:5])
        size = np.array([len(r[5]) for r in rows])
        raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, begin = np.repeat(np.cumsum(size) - size, n) + step, start[row] + step
        rank = _ranks(key.tolist(), sub.tolist())[row]
        gone = repeated_windows(raw, at, np.unique(p, return_inverse=True)[1][row], rank, begin, window)
        left = [(int(p[r]), int(key[r]), int(sub[r]), int(b), 1, raw[a : a + window].tobytes()) for r, a, b in zip(row[~gone], at[~gone], begin[~gone])] if len({*p.tolist()}) == 1 else []
        owner, a, b = _merged(rank[gone], begin[gone], begin[gone] + window)
        of = {k: (int(key[r]), int(sub[r])) for k, r in zip(rank.tolist(), row.tolist())}
        keys, subs = [of[k][0] for k in owner.tolist()], [of[k][1] for k in owner.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(subs, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "sub", "start", "end"]), left

    for batch in batches:
        told: list[tuple] = []
        for r in zip(*(batch.column(c).to_pylist() for c in _SUFFIX_NAMES)):
            if r[5] is None:
                told.append((r[1], r[2], r[3], r[3] + window))
                continue
            if waiting and held >= least and (waiting[-1][0] != r[0] or waiting[0][0] == r[0]):
                found, left = work(waiting)
                yield found
                waiting = left if waiting[0][0] == r[0] else []
                held = len(waiting)
                least = max(SORTED, 2 * held)
            waiting.append(r)
            held += r[4]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told)], ["key", "sub", "start", "end"])
    if waiting:
        yield work(waiting)[0]


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(texts(batch), batch.column("spans").to_pylist()):
            raw = text.encode()
            at = np.array([(s["start"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2)
            _, begin, end = _merged(np.zeros(len(at), np.int64), at[:, 0], np.minimum(at[:, 1], len(raw)))
            kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)]))
            out.append((len(raw), len(raw) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        n, removed, spans, sha, kept = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    """key (doc_id, null as the smallest), sub (a hash of the text) and text."""
    return docs.select(id_key().alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sub"), "text")


def repeated_spans(whole: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, sub, start, end) of bytes that repeat earlier ones; spans may overlap.  ``whole``: key, sub and text."""
    found = _block_pass(whole.mapInArrow(lambda b: _scan(b, window, gram), _FOUND), window)
    rims = found.where("rim").groupBy("key", "sub").agg(F.collect_list(F.struct("start", "n", "p")).alias("rims"))
    suffixes = whole.join(rims, ["key", "sub"]).mapInArrow(lambda b: _suffixes(b, window), _SUFFIXES)
    later = suffixes.repartition("p").sortWithinPartitions("p", "key", "sub", "start").mapInArrow(lambda b: _sorted_groups(b, window), "key long, sub long, start long, end long")
    return found.where("not rim").select("key", "sub", "start", "end").unionByName(later)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the bytes that are left, as ``kept``."""
    whole = keyed(docs)
    spans = repeated_spans(whole, window, gram).groupBy("key", "sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = whole.join(spans, ["key", "sub"], "left").mapInArrow(lambda b: _kept(b, with_text), "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(id_back("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op2_substrings": op2_substrings}
SQL: dict[str, str] = {}
