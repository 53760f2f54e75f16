"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Bytes are embedded, learned
filters slide over each chunk, and each filter keeps its strongest response in the chunk.  Mean, highest
and lowest of these over the document's chunks go through one hidden layer to one probability.

The network is fitted on the driver, on labelled rows whose crc32(doc_id) mod 3 is not 1: those of the lowest hash of doc_id,
at most ``SAMPLE`` rows (parameter ``sample``), of at most ``TEXT_BYTES`` each and ``TRAIN_BYTES`` together.  Rows beyond these bounds
are not learned from; of those within, every step takes whole texts, in blocks of chunks, so training pools what scoring
pools.  Scoring reads whole texts of any length, row by row and in blocks of chunks, and shuffles nothing; the weights that go
with the tasks have a fixed size.

Defined results: a null text is empty, and an empty one is scored as one chunk of zeros; labels that are
null are not learned from; without any labelled row of both kinds, every score is 0.5; rows whose doc_id
is labelled more than once count with each label; repeated rows give equal rows; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_batches, table, texts

CHUNK, STEP = 512, 448
WIDTH, STRIDE, CODE, FILTERS, HIDDEN = 8, 4, 8, 24, 16
#: Labelled rows and training steps at most; documents in a step.
SAMPLE, STEPS, BATCH = 4_000, 500, 32
#: UTF-8 bytes of one labelled text, and of all that are learned from, at most.
TEXT_BYTES, TRAIN_BYTES = 1 << 20, 32 << 20
#: Chunks worked on at once.
BLOCK = 512
FOLDS, HELD_OUT = 3, 1


def chunks(text: str) -> np.ndarray:
    """[n, CHUNK] bytes; the last chunk ends with the text, or is filled with zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) <= CHUNK:
        return np.concatenate([raw, np.zeros(CHUNK - len(raw), np.uint8)])[None]
    starts = np.append(np.arange(0, len(raw) - CHUNK, STEP), len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


class ByteNet:
    """Weights, forward pass and Adam steps."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        byte = np.arange(256)
        kinds = [(byte >= 97) & (byte <= 122), (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57), byte == 32, byte == 10, byte >= 128, (byte > 32) & (byte < 127) & ~np.isin(byte, [*range(48, 58), *range(65, 91), *range(97, 123)])]
        codes = rng.normal(0, 0.3, (256, CODE))
        codes[:, : len(kinds)] += np.stack(kinds, 1)
        self.p = {
            "codes": codes, "filters": rng.normal(0, (WIDTH * CODE) ** -0.5, (WIDTH * CODE, FILTERS)), "bias": np.zeros(FILTERS),
            "hidden": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)), "shift": np.zeros(HIDDEN), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self._moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self._step = 0

    def responses(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strongest response of each filter in each chunk, and where it is."""
        coded = self.p["codes"][found]
        windows = np.lib.stride_tricks.sliding_window_view(coded.reshape(len(found), -1), WIDTH * CODE, axis=1)[:, :: STRIDE * CODE]
        windows = np.ascontiguousarray(windows)
        r = windows.reshape(-1, WIDTH * CODE) @ self.p["filters"]
        r = r.reshape(len(found), -1, FILTERS)
        at = r.argmax(1)
        return np.take_along_axis(r, at[:, None], 1)[:, 0] + self.p["bias"], at

    def pooled(self, strongest: np.ndarray, starts: np.ndarray) -> np.ndarray:
        active = np.tanh(strongest)
        n = np.diff(np.append(starts, len(active)))[:, None]
        return np.concatenate([np.add.reduceat(active, starts) / n, np.maximum.reduceat(active, starts), np.minimum.reduceat(active, starts)], 1)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(pooled @ self.p["hidden"] + self.p["shift"])
        return hidden, hidden @ self.p["out"] + self.p["base"]

    def score(self, batch: list[str]) -> np.ndarray:
        """The probability of label 1 of each whole text."""
        scores = np.empty(len(batch))
        waiting: list[np.ndarray] = []
        strongest: list[np.ndarray] = []
        sizes = []

        def work() -> None:
            found = np.concatenate(waiting)
            strongest.extend(self.responses(found[k : k + BLOCK])[0] for k in range(0, len(found), BLOCK))
            waiting.clear()

        for text in batch:
            found = chunks(text)
            sizes.append(len(found))
            waiting.append(found)
            if sum(map(len, waiting)) >= BLOCK or len(waiting) >= BLOCK:
                work()
        if waiting:
            work()
        if batch:
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            logit = self.head(self.pooled(np.concatenate(strongest), starts))[1].astype(float)
            scores[:] = 1 / (1 + np.exp(-logit))
        return scores

    def step(self, batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, decay: float = 1e-4) -> float:
        starts = np.concatenate(([0], np.cumsum([len(c) for c in batch])[:-1]))
        found = np.concatenate(batch)
        parts = range(0, len(found), BLOCK)
        strongest, at = (np.concatenate(x) for x in zip(*(self.responses(found[k : k + BLOCK]) for k in parts)))
        active = np.tanh(strongest)
        pooled = self.pooled(strongest, starts)
        hidden, logit = self.head(pooled)
        prob = 1 / (1 + np.exp(-logit))
        d_logit = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": hidden.T @ d_logit, "base": d_logit.sum(keepdims=True)}
        d_hidden = d_logit[:, None] * self.p["out"] * (1 - hidden**2)
        g |= {"hidden": pooled.T @ d_hidden, "shift": d_hidden.sum(0)}
        mean, high, low = np.split(d_hidden @ self.p["hidden"].T, 3, 1)
        n = np.diff(np.append(starts, len(found)))
        doc = np.repeat(np.arange(len(batch)), n)
        _, top, bottom = np.split(pooled, 3, 1)
        at_top, at_bottom = active == top[doc], active == bottom[doc]
        ties = lambda x: np.add.reduceat(x, starts, dtype=np.float32)[doc]
        d_active = mean[doc] / n[doc, None] + high[doc] * at_top / ties(at_top) + low[doc] * at_bottom / ties(at_bottom)
        d_strong = d_active * (1 - active**2)
        g["bias"] = d_strong.sum(0)
        g["filters"], g["codes"] = np.zeros_like(self.p["filters"]), np.zeros((256, CODE))
        for k in parts:
            own, d = found[k : k + BLOCK], d_strong[k : k + BLOCK]
            place = at[k : k + BLOCK, :, None] * STRIDE + np.arange(WIDTH)
            taken = own[np.arange(len(own))[:, None, None], place].astype(np.int64)  # the bytes each filter answered to
            g["filters"] += np.einsum("cfw,cf->wf", self.p["codes"][taken].reshape(len(own), FILTERS, -1), d, optimize=True)
            cell = taken[..., None] * CODE + np.arange(CODE)
            g["codes"] += np.bincount(cell.ravel(), (d[..., None] * self.p["filters"].T).ravel(), 256 * CODE).reshape(256, CODE)
        self._step += 1
        for k, v in self.p.items():
            m, s = self._moments[k]
            d = g[k].astype(np.float32) + decay * v
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            v -= rate * (m / (1 - 0.9**self._step)) / (np.sqrt(s / (1 - 0.99**self._step)) + 1e-6)
        return float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum())


def fit(cut: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> ByteNet | None:
    """``cut`` has the chunks of each row.  None unless both labels occur."""
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng, net = np.random.default_rng(seed), ByteNet(seed)
    # Each step has the rarer label in a third of its documents; weights undo half of that.
    by = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    rare = min(by, key=len)
    share = max(1 / 3, len(rare) / len(y))
    n_rare = round(BATCH * share)
    other = by[0] if rare is by[1] else by[1]
    undo = ((len(rare) / len(y)) / share) ** 0.5
    for k in range(steps):
        picked = np.concatenate([rng.choice(rare, n_rare), rng.choice(other, BATCH - n_rare)])
        batch = [cut[i] for i in picked]
        weight = np.where(np.arange(BATCH) < n_rare, undo, 1.0)
        net.step(batch, y[picked], weight, rate=3e-3 * min(1, 2 * (1 - k / steps)))
    return net


def _fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, steps: int = STEPS) -> ByteNet | None:
    """Fits on at most ``sample`` labelled rows outside the held-out fold, whole texts of at most ``TRAIN_BYTES`` together."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where((_fold("id") != HELD_OUT) & F.col("y").isNotNull())
    picked = known.orderBy(F.md5(F.col("id").cast("string")), "id", "y").limit(sample)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.select(F.md5(F.col("id").cast("string")).alias("hash"), (F.col("y") == 1).alias("good"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("of"), "text").where(F.col("size") <= TEXT_BYTES)
    order = ["hash", "good", "size", "of"]
    # Sizes first, so that only texts within the bound come to the driver.
    sizes = [r["size"] for r in rows.orderBy(*order).limit(sample).select("size").collect()]
    n = int(np.searchsorted(np.cumsum(sizes), TRAIN_BYTES, "right")) if sizes else 0
    told = rows.orderBy(*order).limit(n).collect()
    return fit([chunks(r["text"]) for r in told], np.array([int(r["good"]) for r in told]), steps)


def _scorer(net: ByteNet | None):
    """A function of a batch that goes with the tasks: the weights, and no training state."""
    params = net.p if net else None

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        if params is None:
            return np.full(batch.num_rows, 0.5)
        own = ByteNet.__new__(ByteNet)
        own.p = params
        return own.score(texts(batch))

    return scores


def score(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id and score."""
    scores = _scorer(net)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch))], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, score double")


def accepted(docs: DataFrame, net: ByteNet | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    scores = _scorer(net)
    return docs.mapInArrow(lambda batches: (b.filter(pa.array(scores(b) >= threshold)) for b in batches), docs.schema)


def with_verdict(scored: DataFrame) -> DataFrame:
    return scored.withColumn("held_out", _fold() == HELD_OUT).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    return with_verdict(score(docs, net)).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
