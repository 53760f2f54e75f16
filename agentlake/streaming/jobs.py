"""Continuous forms of the batch operators, on Structured Streaming.

Keyed jobs are ``transformWithState`` processors.  Their state is a few typed numbers per key: a window's start and count, a sum, a
streak, an unfinished tag, since when something is pending.  Timers drop it once it tells nothing any more: behind the watermark
when the window or month is over; a call that isn't denied and a stream's last piece drop it at once.  A key's rows of
one micro-batch are sorted in one task (``maxFilesPerTrigger`` of the source bounds a micro-batch); rows that come in a later
micro-batch with an earlier time than rows before them, within the watermark, count as if they had come in that place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from agentlake.operators import memory, retrieval, tables
from agentlake.sources import buckets


def windowed_counts(events: DataFrame, by: tuple[str, ...], width: str = "1 minute", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Tumbling counts by bounded labels (outcomes, modes, statuses), with the sum of a value; late events until the watermark."""
    ready = events.withWatermark("ts", late) if events.isStreaming else events
    more = [F.round(F.sum(value), 4).alias("total")] if value else []
    return ready.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), *more).select(F.col("w.start").alias("start"), *by, "n", *(["total"] if value else []))


def windowed_histogram(events: DataFrame, value: str, bounds: tuple[float, ...], by: tuple[str, ...], width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and bucket; ``at`` is the place of the first bound that holds the value."""
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value)))
    return windowed_counts(events.withColumn("at", at), (*by, "at"), width, late)


def _sorted(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(by))


def _watermarked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


class _Keyed(StatefulProcessor):
    """One value of state per key, in ``self.state``; ``columns`` are those of the output."""

    shape = ""
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.shape)

    def before(self, nothing: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else nothing

    def only_timer(self, ms: int, now: int) -> None:
        """The key's one timer; those set before go."""
        self.no_timer()
        self.handle.registerTimer(max(ms, now + 1))

    def no_timer(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)

    def none(self) -> pd.DataFrame:
        return pd.DataFrame({c: [] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield self.none()

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, by: tuple[str, ...], processor: _Keyed, schema: str, time_mode: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor.columns = tuple(c.split()[0] for c in schema.split(", "))
    return rows.groupBy(*by).transformWithStateInPandas(processor, schema, "Append", time_mode)


class _RateWindows(_Keyed):
    shape = "start long, n long"

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.before((0, 0))
        rows, starts, places = _sorted(rows, "us", "event_id"), [], []
        for us in rows["us"].tolist():
            if not n or us - start >= self.width:
                start, n = us, 0
            n += 1
            starts.append(start)
            places.append(n)
        self.state.update((start, n))
        self.only_timer((start + self.width) // 1000 + 1, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "start": starts, "place": places, "allowed": [p <= self.limit for p in places]})


def rate_limited(events: DataFrame, seconds: float = 60.0, limit: int = 20, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, start, place, allowed: windows anchored at their first event, as ``governance.rate_windows``."""
    rows = _watermarked(events, late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return _stateful(rows, ("user_id",), _RateWindows(int(seconds * 1e6), limit), "user_id long, event_id long, start long, place long, allowed boolean", "EventTime")


class _Quota(_Keyed):
    shape = "used long"

    def __init__(self, quota: int):
        self.quota = quota

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _sorted(rows, "us", "event_id")
        used = self.before((0,))[0] + rows["tokens"].cumsum()
        self.state.update((int(used.iloc[-1]),))
        self.only_timer(int((pd.Timestamp(f"{key[1]}-01") + pd.DateOffset(months=1, days=1)).timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
        first = rows.assign(used=used)[(used >= self.quota) & (used - rows["tokens"] < self.quota)]
        yield pd.DataFrame({"user_id": key[0], "month": key[1], "event_id": first["event_id"], "used": first["used"]})


def running_quota(usage: DataFrame, quota: int, late: str = "10 minutes") -> DataFrame:
    """user_id, month, event_id, used of the event that first reaches the quota; as ``governance.quota_crossings``."""
    rows = _watermarked(usage, late).select("user_id", "month", "event_id", "ts", F.unix_micros("ts").alias("us"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return _stateful(rows, ("user_id", "month"), _Quota(quota), "user_id long, month string, event_id long, used long", "EventTime")


class _Streak(_Keyed):
    shape = "streak int"

    def __init__(self, n: int):
        self.n = n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        streak, hits = self.before((0,))[0], []
        for pos, denied in _sorted(rows, "pos")[["pos", "denied"]].itertuples(index=False, name=None):
            streak = streak + 1 if denied else 0
            if streak == self.n:
                hits.append(pos)
        if streak:
            self.state.update((streak,))
        else:
            self.state.clear()
        yield pd.DataFrame({"run_id": key[0], "pos": pd.Series(hits, dtype="int64")})


def denial_alerts(events: DataFrame, n: int = 5) -> DataFrame:
    """run_id, pos of the call that makes a streak of ``n`` denials."""
    return _stateful(events.select("run_id", "pos", "denied"), ("run_id",), _Streak(n), "run_id string, pos long", "None")


OPEN, CLOSE = "<think>", "</think>"


def split_reasoning(text: str, inside: bool) -> tuple[str, str, str, bool]:
    """(visible, thinking, unfinished rest, inside) of a piece of text; a tag may be cut at the end."""
    out = {False: [], True: []}
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at < 0:
            keep = next((k for k in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-k:])), 0)
            out[inside].append(text[: len(text) - keep])
            return "".join(out[False]), "".join(out[True]), text[len(text) - keep :], inside
        out[inside].append(text[:at])
        text, inside = text[at + len(tag) :], not inside


class _Reasoning(_Keyed):
    shape = "rest string, inside boolean"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, inside = self.before(("", False))
        out, ended = [], False
        for seq, text, last in _sorted(rows, "seq")[["seq", "text", "last"]].itertuples(index=False, name=None):
            visible, thinking, rest, inside = split_reasoning(rest + text, inside)
            if last:  # what looked like a tag was text
                visible, thinking, rest = (visible, thinking + rest, "") if inside else (visible + rest, thinking, "")
            out.append((key[0], seq, visible, thinking))
            ended = bool(last)
        if ended:
            self.state.clear()
        else:
            self.state.update((rest, bool(inside)))
        yield pd.DataFrame(out, columns=["stream", "seq", "visible", "thinking"])


def reasoning_deltas(deltas: DataFrame) -> DataFrame:
    """stream, seq, visible, thinking of deltas (stream, seq, text, last), with tags that deltas cut in two."""
    return _stateful(deltas, ("stream",), _Reasoning(), "stream long, seq long, visible string, thinking string", "None")


class _Stale(_Keyed):
    shape = "since long"

    def __init__(self, seconds: int, clock: bool):
        self.us, self.clock = seconds * 1_000_000, clock

    def _told(self, key, late: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"doc_key": key[0], "since": pd.to_datetime(pd.Series(late, dtype="int64"), unit="us"), "status": "failed"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, late = self.before((None,))[0], []
        for us, status in _sorted(rows, "us")[["us", "status"]].itertuples(index=False, name=None):
            if since is not None and us - since > self.us:
                late.append(since)
            since = us if status == "pending" else None
        if since is None:
            self.state.clear()
            self.no_timer()
        else:
            self.state.update((since,))
            now = timerValues.getCurrentProcessingTimeInMs() if self.clock else timerValues.getCurrentWatermarkInMs()
            self.only_timer((since + self.us) // 1000 + 1, now)
        yield self._told(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.before((None,))[0]
        self.state.clear()
        yield self._told(key, [] if since is None else [since])


def stale_pending(changes: DataFrame, seconds: int, late: str = "10 minutes", clock: bool = False) -> DataFrame:
    """doc_key, since, status (failed): documents that were pending for more than ``seconds`` without a word.

    ``changes`` has doc_key, status and ts.  A timer per document goes off when the watermark has passed, or with ``clock``
    when the clock of the workers has; a change that comes too late itself tells it too, so that the result does not hang
    on how changes fall into micro-batches.
    """
    rows = (changes if clock else _watermarked(changes, late)).select("doc_key", "status", "ts", F.unix_micros("ts").alias("us"))
    return _stateful(rows, ("doc_key",), _Stale(seconds, clock), "doc_key string, since timestamp, status string", "ProcessingTime" if clock else "EventTime")


def append_by_day(events: DataFrame, path: str, checkpoint: str, ts: str = "ts", fmt: str = "parquet") -> StreamingQuery:
    """Audit and run logs: each row once, in the folder of its day."""
    dated = events.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    return dated.writeStream.format(fmt).partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def foreach_bucket(changes: DataFrame, root: str, checkpoint: str, key: tuple[str, ...], apply: Callable[[DataFrame, DataFrame], DataFrame], bound: str | None = None) -> StreamingQuery:
    """A table in buckets of ``key`` that each batch changes: ``apply(rows of the touched buckets, batch)``; see ``buckets.change``.

    With ``bound`` the stream goes on and takes what has come at that interval; without, it ends once all is read.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def step(batch: DataFrame, number: int) -> None:
        # The batch's rows are read for its buckets and for the change itself.
        batch.persist()
        try:
            buckets.change(batch, number, root, own, key, apply)
        finally:
            batch.unpersist()

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=bound) if bound else writer.trigger(availableNow=True)).start()


def ingest_stream(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Changed documents replace their chunks (a table in buckets of doc_key); of several changes in a batch the last version counts."""

    def apply(now: DataFrame, batch: DataFrame) -> DataFrame:
        newest = batch.groupBy("doc_key").agg(F.max("version").alias("version"))
        return tables.replaced(now, batch.join(newest, ["doc_key", "version"]).select(*now.columns), ("doc_key",))

    return foreach_bucket(changes, root, checkpoint, ("doc_key",), apply)


def memory_stream(writes: DataFrame, root: str, checkpoint: str, cap: int = memory.CAP) -> StreamingQuery:
    """Memories written to a table in buckets of user_id."""
    return foreach_bucket(writes, root, checkpoint, ("user_id",), lambda now, batch: memory.apply_memories(now, batch, cap))


#: How old the lexical index may be.
FRESH = "300 seconds"


def index_stream(changes: DataFrame, root: str, checkpoint: str, bound: str | None = FRESH) -> StreamingQuery:
    """The stored lexical index, a table in buckets of doc_key, follows changed chunks (all of a document's): within ``bound``, or once without."""
    return foreach_bucket(changes, root, checkpoint, ("doc_key",), retrieval.updated_index, bound)
