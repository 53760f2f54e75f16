r"""Substring dedup by repeated-phrase automata: every word that lies in a window of 20 words seen before goes.

1. *Recurring passages.*  A window's anchor is its lowest-hashed run of ``GRAM`` words, so equal windows have equal anchors and
   neighbours share theirs: a run of windows with one anchor is a block, about 7 windows, and one record.  Blocks meet by
   anchor.  Of equal blocks (64-bit anchor and 64-bit digest) each but the first is linked to an earlier one; blocks that share an
   anchor and differ are rims.  Hashes only propose; what they pass over is a repeat that collides in 128 bits.
2. *Automata.*  Documents give up, once, the words of their linked stretches, of the blocks that links lead to, and of rims.
   They travel to the shard of the document linked to, or of the rim's anchor.  A shard compiles its passages (the stretches linked
   to, or their blocks; of rims the windows that recur) into Aho-Corasick automata over words, and streams its texts through them: each
   match of a passage that starts earlier than the match is a window that goes.  Words decide, so nothing goes that does not repeat.
3. The documents meet their matches and lose the words covered.

The words of all documents are shuffled once, compressed (``packed``): steps 2 and 3 read the same exchange, as they are one query and
nothing is staged between them.

Hot passages: a task links the copies it holds itself, per ``CHUNK`` words (to the one before in the same text, or to the first), and hands on the first; of those, the first is linked
to by ``FAN`` others and each later one by one, so what a shard gathers is bounded by a document and a chunk, however
many copies there are.  Rims of an anchor with over ``GROUP`` blocks go by window instead: the first of a batch travels, the others
are linked to it.  A task works on whole shards of about ``BATCH`` words; larger ones compile their passages in slices, long passages
in pieces, and stream their texts past each.

Defined results: a null text has no words; texts of fewer than 20 words lose nothing; matches never cross documents; a null doc_id
counts as the smallest and comes back null; rows that share a doc_id are documents of their own, in the order of a hash of their
texts, and those that share the text too count as one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import id_back, map_batches, table, texts
from .op02_substrings import _merged, _mixed, _ranks, _sliding_min, keyed

WINDOW, GRAM = 20, 8
#: Words hashed at once; blocks that link to the first of their kind; blocks of an anchor above which rims go by window.
CHUNK, FAN, GROUP = 1 << 20, 64, 256
#: Words of the shards that are worked on at once.
BATCH = 400_000
BLOCK, LED, LINK, PART = range(4)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """What blanks, tabs and line ends part (ASCII ones only)."""
    return (text or "").encode().split()


def packed(whole: DataFrame) -> DataFrame:
    """key, sub and the words of ``text``, joined by blanks and compressed (``size``: bytes before that)."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, raw = pa.Codec("zstd", 1), [b" ".join(words_of(t)) for t in batch.column("text").to_pylist()]
        words = pa.array([codec.compress(r, asbytes=True) if r else r for r in raw], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("sub"), words, pa.array(map(len, raw), pa.int64())], ["key", "sub", "words", "size"])

    return map_batches(whole, pack, "key long not null, sub long not null, words binary, size long")


def _unpacked(batch: pa.RecordBatch) -> Callable[[int], list[bytes]]:
    """The words of a row of ``packed``, row by row."""
    codec, words, sizes = pa.Codec("zstd"), batch.column("words"), batch.column("size").to_pylist()
    return lambda k: codec.decompress(words[k].as_buffer(), sizes[k], asbytes=True).split() if sizes[k] else []


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    return _mixed(h[:-step] * _FACTOR + h[step:])


def blocks(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """first start, number of windows, anchor and digest of each block; ``h``: hashes of words, ``valid``: the starts that count."""
    for step in (1, 2, 4):
        h = _doubled(h, step)
    wide = _doubled(h, GRAM)
    place = np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min((h & _HIGH) | place, WINDOW - GRAM + 1) & _LOW).astype(np.int64)
    at = np.flatnonzero(valid[: len(anchor)])
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchor[at]) != 0)))) if len(at) else at
    first, n = at[new], np.diff(np.append(new, len(at)))
    # A block has at most 32 words: the strings of 16 at its begin and end cover it.
    return first, n, h[anchor[first]], _mixed(_mixed(wide[first] * _FACTOR + wide[first + n + WINDOW - 1 - 2 * GRAM]) + n.astype(np.uint64))


def _earlier(groups: tuple[np.ndarray, ...], rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row an earlier one with equal values in all of ``groups``: the one before it in its own text, or else the first of all (itself, if it is that).

    So the repeats of a text that goes round in circles stand at one distance from what they are linked to, and make one stretch.
    """
    order = np.lexsort((start, rank, *groups))
    new = np.concatenate(([True], np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)))
    own = np.concatenate(([False], rank[order][1:] == rank[order][:-1])) & ~new
    place = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = order[np.where(own, place - 1, np.flatnonzero(new)[np.cumsum(new) - 1])]
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _runs(*same: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by ``same`` and start: the rows that begin a run of overlapping or adjoining spans, and the lengths of these runs."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    change = np.any([x[1:] != x[:-1] for x in same], axis=0)
    base = np.concatenate(([0], np.cumsum(change))) << 40  # texts are shorter
    reach = np.maximum.accumulate(start + n + base)
    at = np.flatnonzero(np.concatenate(([True], change | ((start + base)[1:] > reach[:-1]))))
    return at, np.maximum.reduceat(start + n, at) - start[at]


_FOUND = "p long, digest long, key long, sub long, start long, n int, kind int, to_key long, to_sub long, to_start long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCK and LED (a local copy is linked to it) rows of what is first in its chunk, LINK rows of copies, and PART rows of copies that others are linked to."""

    def found(pieces: list[tuple[int, np.ndarray, int]], key_of: np.ndarray, sub_of: np.ndarray, ranks: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum([len(h) for _, h, _ in pieces])
        begins = np.concatenate(([0], ends[:-1]))
        valid = np.ones(ends[-1], bool)
        for e in ends:
            valid[e - WINDOW + 1 : e] = False
        first, n, p, digest = blocks(np.concatenate([h for _, h, _ in pieces]), valid)
        piece = np.searchsorted(ends, first, "right")
        row, start = np.array([k for k, _, _ in pieces])[piece], first - begins[piece] + np.array([a for _, _, a in pieces])[piece]
        lead = _earlier((digest, p), ranks[row], start)
        copy = (ranks[row] != ranks[row[lead]]) | (start != start[lead])
        led = np.zeros(len(row), bool)
        led[lead[copy]] = True
        to = lead[copy]
        order = np.lexsort((start[copy], start[copy] - start[to], row[to], row[copy]))
        mine, to = np.flatnonzero(copy)[order], to[order]
        at, size = _runs(row[mine], row[to], start[mine] - start[to], start=start[mine], n=n[mine])
        mine, to = mine[at], to[at]
        own, part = np.flatnonzero(~copy), np.flatnonzero(copy & led)
        both = np.concatenate((own, part, mine))
        alone = both[len(own) :]  # these meet nothing by their anchor
        spread = _mixed(digest[alone] + _mixed(key_of[row[alone]].view(np.uint64) + start[alone].astype(np.uint64)))
        none = pa.nulls(len(own) + len(part), pa.int64())
        ahead = [pa.concat_arrays([none, _long(x)]) for x in (key_of[row[to]], sub_of[row[to]], start[to])]
        return pa.RecordBatch.from_arrays(
            [_long(np.concatenate((p[own], spread))), _long(digest[both]), _long(key_of[row[both]]), _long(sub_of[row[both]]), _long(start[both]), pa.array(np.concatenate((n[own], n[part], size)).astype(np.int32)),
             pa.array(np.concatenate((np.where(led[own], LED, BLOCK), np.full(len(part), PART), np.full(len(mine), LINK))).astype(np.int32)), *ahead], [c.split()[0] for c in _FOUND.split(", ")])

    for batch in batches:
        keys, subs, rows = batch.column("key").to_pylist(), batch.column("sub").to_pylist(), texts(batch)
        ranks = _ranks(keys, subs)
        about = np.array(keys, np.int64), np.array(subs, np.int64), ranks
        waiting, size = [], 0
        for k in np.argsort(ranks, kind="stable").tolist():
            h = hashed(words_of(rows[k]))
            for a in range(0, len(h) - WINDOW + 1, CHUNK):
                waiting.append((k, h[a : a + CHUNK + WINDOW - 1], a))
                size += len(waiting[-1][1])
                if size >= CHUNK:
                    yield found(waiting, *about)
                    waiting, size = [], 0
        if waiting:
            yield found(waiting, *about)


def linked(found: DataFrame) -> DataFrame:
    """(key, sub, start, n, to, lead, rim, hot): blocks and stretches with the earlier place they repeat (``to``), blocks that others
    are linked to (``lead``), and blocks whose anchor (``rim``) has others that differ, ``hot`` if many."""
    same, anchor = Window.partitionBy("p", "digest").orderBy("key", "sub", "start"), Window.partitionBy("p")
    place = F.struct("key", "sub", "start")
    ranked = found.repartition("p").withColumns({"nth": F.row_number().over(same), "first": F.first(place).over(same), "back": F.lag(place, FAN).over(same), "next": F.lead("key").over(same), "far": F.lead("key", FAN).over(same)})
    ranked = ranked.withColumns({"low": F.min("digest").over(anchor), "high": F.max("digest").over(anchor), "size": F.count(F.lit(1)).over(anchor)})
    link, alone = F.col("kind") == LINK, F.col("kind") >= LINK
    to = F.when(link, F.struct(F.col("to_key").alias("key"), F.col("to_sub").alias("sub"), F.col("to_start").alias("start"))).when(F.col("nth") > FAN, F.col("back")).when(F.col("nth") > 1, F.col("first"))
    lead = (F.col("kind") == PART) | ~alone & ((F.col("kind") == LED) | ((F.col("nth") == 1) & F.col("next").isNotNull()) | F.col("far").isNotNull())
    rim = F.when(~alone & (F.col("nth") == 1) & (F.col("low") < F.col("high")), F.col("p"))
    out = ranked.select("key", "sub", "start", "n", to.alias("to"), lead.alias("lead"), rim.alias("rim"), (F.col("size") > GROUP).alias("hot"))
    return out.where(F.col("to").isNotNull() | F.col("lead") | F.col("rim").isNotNull())


PASSAGE, TEXT, RIM = range(3)
_TRAVEL = "shard long, kind int, key long, sub long, start long, words binary, blocks array<int>, to_start long"


def _shard(value: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value) - 2**63


def _of_document(key: int, sub: int) -> int:
    return _shard(b"%d,%d" % (key, sub))


def _hot_windows(spans: list[tuple[int, int, int]], words_at: Callable[[int], list[bytes]], ranks: np.ndarray) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each window of ``spans`` (row, start, n) with its places (row, start), earliest first."""
    places: dict[bytes, list[tuple[int, int, int]]] = {}
    last, words = -1, []
    for row, start, n in sorted(spans):
        if row != last:
            last, words = row, words_at(row)
        for s in range(start, start + n):
            places.setdefault(b" ".join(words[s : s + WINDOW]), []).append((int(ranks[row]), row, s))
    for window, at in places.items():
        yield window, [p[1:] for p in sorted(at)]


def _travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards: PASSAGE (``blocks``: start and windows of each in turn), TEXT (``to_start``: where the document it is linked to has it) and RIM."""
    names, kinds = [c.split()[0] for c in _TRAVEL.split(", ")], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64())
    for batch in batches:
        keys, subs, words_at, lists = batch.column("key").to_pylist(), batch.column("sub").to_pylist(), _unpacked(batch), batch.column("spans")
        flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        whole = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, n, lead, rim, hot = (whole(flat.field(c).cast(pa.int64())) for c in ("start", "n", "lead", "rim", "hot"))
        linked, rimmed = (flat.field(c).is_valid().to_numpy(zero_copy_only=False) for c in ("to", "rim"))
        links = np.stack([row, *map(whole, flat.field("to").flatten()), start, n])[:, linked]
        leads = np.stack([row, start, n])[:, lead > 0]
        todo: defaultdict[int, list[tuple]] = defaultdict(list)
        for k in np.flatnonzero(rimmed & (hot == 0)).tolist():
            todo[int(row[k])].append((int(rim[k]), RIM, int(start[k]), int(n[k]), None, None))
        more_links, more_leads = [], []
        for window, ((r, s), *others) in _hot_windows(list(zip(*(x[rimmed & (hot > 0)].tolist() for x in (row, start, n)))), words_at, _ranks(keys, subs)):
            todo[r].append((_shard(window), RIM, s, 1, None, None))
            if others:
                more_leads.append((r, s, 1))
                more_links += [(q, keys[r], subs[r], s, t, 1) for q, t in others]
        links = np.concatenate([links, np.array(more_links, np.int64).reshape(-1, 6).T], 1)
        leads = np.concatenate([leads, np.array(more_leads, np.int64).reshape(-1, 3).T], 1)
        r, key, sub, to, s, m = links = links[:, np.lexsort((links[4], links[4] - links[3], links[2], links[1], links[0]))]
        at, size = _runs(r, key, sub, s - to, start=s, n=m)
        for q, k, b, t, a, w in zip(*links[:5, at].tolist(), size.tolist()):
            todo[q].append((_of_document(k, b), TEXT, a, w, None, t))
        r, s, m = leads = np.unique(leads, axis=1)
        at, size = _runs(r, start=s, n=m)
        blocks_ = np.stack([s - np.repeat(s[at], np.diff(np.append(at, len(s)))), m], 1).astype(np.int32)
        for q, a, w, low, high in zip(r[at].tolist(), s[at].tolist(), size.tolist(), at.tolist(), [*at[1:].tolist(), len(s)]):
            todo[q].append((_of_document(keys[q], subs[q]), PASSAGE, a, w, blocks_[low:high].ravel(), None))
        out: list[tuple] = []
        for q, rows in todo.items():
            words = words_at(q)
            out += [(shard, kind, keys[q], subs[q], a, b" ".join(words[a : a + w + WINDOW - 1]), own, to_) for shard, kind, a, w, own, to_ in rows]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)


class Shards:
    """Rows of some whole shards: their words as letters, the passages to look for, the texts to stream."""

    def __init__(self, batch: int = BATCH):
        self.batch, self.size = batch, 0
        self._letters: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self._held: defaultdict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        self._rims: list[tuple] = []

    def add(self, shard: int, kind: int, place: tuple[int, int, int], raw: bytes, spans: list[int] | None, to_start: int | None) -> None:
        ids = tuple(map(self._letters.__getitem__, raw.split(b" ")))
        self.size += len(ids)
        if kind == RIM:
            self._rims.append((place, ids))
        else:
            self._held[shard][kind].append((place, ids, spans if kind == PASSAGE else to_start))

    def _cut(self, place: tuple[int, int, int], ids: tuple, a: int, n: int) -> Iterator[tuple]:
        """(letters, windows, place) of ``n`` windows from ``a``, long ones in pieces."""
        most = max(1, self.batch // 4)
        for k in range(a, a + n, most):
            m = min(most, a + n - k)
            yield ids[k : k + m + WINDOW - 1], m, (*place[:2], place[2] + k)

    def passages(self) -> Iterator[tuple]:
        """Per shard the linked stretches, or the blocks that these are made of, whichever are fewer letters; of rims, the windows that recur."""
        for own, linked in self._held.values():
            wanted = {(to, len(ids) - WINDOW + 1) for _, ids, to in linked}
            if sum(n + WINDOW for _, n in wanted) <= sum(n + WINDOW for *_, spans in own for n in spans[1::2]):
                for place, ids, _ in own:
                    for to, n in wanted:
                        if place[2] <= to and to + n + WINDOW - 1 <= place[2] + len(ids):
                            yield from self._cut(place, ids, to - place[2], n)
            else:
                for place, ids, spans in own:
                    for a, n in zip(spans[::2], spans[1::2]):
                        yield from self._cut(place, ids, a, n)
        first: dict[tuple, tuple] = {}
        recurring = set()
        for (key, sub, start), ids in self._rims:
            for k in range(len(ids) - WINDOW + 1):
                window, place = ids[k : k + WINDOW], (key, sub, start + k)
                known = first.setdefault(window, place)
                if known is not place:
                    recurring.add(window)
                    first[window] = min(known, place)
        for window in recurring:
            yield window, 1, first[window]

    def located(self) -> Iterator[tuple[int, int, int, int]]:
        """(key, sub, start, windows) of every match of a passage that starts earlier; at most about 4 * ``batch`` letters are compiled at once."""
        import ahocorasick

        streams = [(place, ids) for _, linked in self._held.values() for place, ids, _ in linked] + self._rims
        passages, more = self.passages(), True
        while more:
            automaton, size, more = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0, False
            for letters, n, place in passages:
                known = automaton.get(letters, None)
                if known is None or place < known[1]:
                    automaton.add_word(letters, (n, place))
                size += len(letters)
                if size >= 4 * self.batch:
                    more = True
                    break
            if not size:
                return
            automaton.make_automaton()
            for (key, sub, start), ids in streams:
                for end, (n, place) in automaton.iter(ids):
                    found = (key, sub, start + end - n - WINDOW + 2)
                    if place < found:
                        yield (*found, n)


def _shards(batches: Iterator[pa.RecordBatch], batch: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; out: key, sub, start, end of what goes, as spans of words."""
    held, last = Shards(batch), None

    def work(held: Shards) -> pa.RecordBatch:
        gone = list(held.located())
        of = sorted({g[:2] for g in gone})
        at = {k: i for i, k in enumerate(of)}
        owner, a, b = _merged(np.array([at[g[:2]] for g in gone], np.int64), np.array([g[2] for g in gone], np.int64), np.array([g[2] + g[3] + WINDOW - 1 for g in gone], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([of[k][0] for k in owner], pa.int64()), pa.array([of[k][1] for k in owner], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "sub", "start", "end"])

    for rows in batches:
        for shard, kind, key, sub, start, raw, spans, to in zip(*(rows.column(c).to_pylist() for c in rows.schema.names)):
            if held.size >= batch and shard != last:
                yield work(held)
                held = Shards(batch)
            last = shard
            held.add(shard, kind, (key, sub, start), raw, spans, to)
    yield work(held)


def repeated_words(whole: DataFrame, words: DataFrame, batch: int = BATCH) -> DataFrame:
    """(key, sub, start, end): spans of words that windows seen before cover; spans may overlap.  ``whole``: key, sub and text; ``words``: ``packed``."""
    spans = linked(whole.mapInArrow(_scan, _FOUND)).groupBy("key", "sub").agg(F.collect_list(F.struct("start", "n", "to", "lead", "rim", "hot")).alias("spans"))
    travelling = words.join(spans, ["key", "sub"]).mapInArrow(_travelling, _TRAVEL)
    return travelling.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda b: _shards(b, batch), "key long, sub long, start long, end long")


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        words_at = _unpacked(batch)
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            words = words_at(k)
            at = np.array([(s["start"], s["end"]) for s in spans or ()], np.int64).reshape(-1, 2)
            _, begin, end = _merged(np.zeros(len(at), np.int64), at[:, 0], at[:, 1])
            left = [w for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(words)]) for w in words[a:b]]
            kept = b" ".join(left)
            out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        n, removed, sha, kept = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_phrases(docs: DataFrame, with_text: bool = False, batch: int = BATCH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the words that are left, joined by blanks, as ``kept``."""
    whole = keyed(docs)
    words = packed(whole)
    spans = repeated_words(whole, words, batch).groupBy("key", "sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = words.join(spans, ["key", "sub"], "left").mapInArrow(lambda b: _kept(b, with_text), "key long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.select(id_back("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op11_phrases": op11_phrases}
SQL: dict[str, str] = {}
