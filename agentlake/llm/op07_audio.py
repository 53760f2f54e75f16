"""Media columns: audio features of payloads stored as lossless 8-bit PCM.

Each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, become the samples of a WAV
file.  What is stored is read back, resampled by a polyphase filter, cut into overlapping frames, turned
into log-mel bands, and split into active spans by two energy thresholds (a span begins above the higher
one and lasts while the lower one holds).  The bands are kept as fixed-shape Arrow tensors with the time
span of each, in an Arrow IPC stream per row, so that any Arrow reader gets tensors back.

A row is worked through in blocks of frames, each text by itself, so equal texts give equal values.  A
block's bands are written to the tensor stream at once; beyond the text, its stored form and that stream,
memory holds one block and one energy per frame.  ``feature`` tells what a reader of the stored stream
gets: the tensors' shape and digest, and the spans.  No rows are shuffled.

Defined results: a null text is empty and has 64 zero samples; repeated rows give equal rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_batches, table, texts

RATE, UP, DOWN = 16_000, 5, 8
TAPS = 60
FRAME, HOP, BANDS = 256, 128, 24
#: Frames in one stored tensor.
TENSOR_FRAMES = 64
#: Frames worked on at once: whole tensors, and HOP * BLOCK is a multiple of UP, so blocks start at whole input samples.
BLOCK = 60 * TENSOR_FRAMES
#: Milliseconds from frame to frame.
STEP_MS = HOP * DOWN / UP * 1000 / RATE
FLOOR = 1e-6

COLUMNS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string",
    "media": "binary", "tensors": "binary", "segments": "array<struct<start_ms:double,end_ms:double>>",
}


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def store(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@functools.cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase matrix (input window -> UP outputs), frame window, mel bands."""
    n = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(n / DOWN) / DOWN * np.hamming(TAPS) * UP
    width = DOWN + TAPS // UP
    phases = np.zeros((width, UP), np.float32)
    for out in range(UP):
        at, phase = divmod(out * DOWN, UP)
        sub = h[phase::UP][::-1]  # newest sample last
        phases[at : at + len(sub), out] = sub
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    at = np.arange(FRAME // 2 + 1)[:, None] * rate / FRAME
    rise, fall = (at - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


def log_mel(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of [frames, BANDS] over the whole signal; what follows its end is silence."""
    phases, window, bands = _filters()
    width = len(phases)
    n_out = -(-len(samples) * UP // DOWN)
    n_frames = max(1, -(-max(0, n_out - FRAME) // HOP) + 1)
    for first in range(0, n_frames, BLOCK):
        frames = min(BLOCK, n_frames - first)
        steps = -(-((frames - 1) * HOP + FRAME) // UP)
        at = first * HOP // UP * DOWN
        part = np.zeros(steps * DOWN + width, np.float32)
        got = samples[at : at + len(part)]
        part[: len(got)] = (got.astype(np.float32) - 128) / 128
        windows = np.lib.stride_tricks.sliding_window_view(part, width)[::DOWN][:steps]
        resampled = (np.ascontiguousarray(windows) @ phases).ravel()
        framed = np.lib.stride_tricks.sliding_window_view(resampled, FRAME)[::HOP][:frames] * window
        spectrum = np.fft.rfft(framed, axis=1)
        yield np.log((spectrum.real**2 + spectrum.imag**2) @ bands + FLOOR).astype(np.float32)


def active_spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end) of runs above the lower threshold that reach the higher one."""
    low, high = energy.mean(), energy.mean() + energy.std() / 2
    edges = np.flatnonzero(np.diff(np.concatenate(([False], energy > low, [False])).astype(np.int8)))
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2]) if energy[s:e].max() > high]


def tensor_batch(bands: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Fixed-shape tensors [TENSOR_FRAMES, BANDS] of the frames from ``first`` on, each with its time span in ms."""
    n = -(-len(bands) // TENSOR_FRAMES)
    filled = np.full((n * TENSOR_FRAMES, BANDS), np.log(FLOOR), np.float32)
    filled[: len(bands)] = bands
    starts = (first + np.arange(n) * TENSOR_FRAMES) * STEP_MS
    ends = np.minimum(starts + TENSOR_FRAMES * STEP_MS, (first + len(bands)) * STEP_MS)
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, TENSOR_FRAMES, BANDS))
    return pa.RecordBatch.from_arrays([tensors, pa.array(starts), pa.array(ends)], ["log_mel", "start_ms", "end_ms"])


def read_tensors(stream: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tensors, start_ms, end_ms) of each stored batch."""
    with pa.ipc.open_stream(stream) as reader:
        for batch in reader:
            yield batch.column("log_mel").to_numpy_ndarray(), batch.column("start_ms").to_numpy(), batch.column("end_ms").to_numpy()


def described(samples: np.ndarray) -> dict:
    """tensors (an Arrow IPC stream), segments, feature."""
    out, energies, total, frames, stream = io.BytesIO(), [], np.zeros(BANDS), 0, None
    for bands in log_mel(samples):
        batch = tensor_batch(bands, frames)
        stream = stream or pa.ipc.new_stream(out, batch.schema)
        stream.write_batch(batch)
        energies.append(bands.mean(axis=1))
        total += bands.sum(axis=0, dtype=np.float64)
        frames += len(bands)
    stream.close()
    spans = active_spans(np.concatenate(energies))
    stored, digest, shape = out.getvalue(), hashlib.sha256(), (0, TENSOR_FRAMES, BANDS)
    for tensors, starts, ends in read_tensors(stored):
        shape = (shape[0] + len(tensors), *tensors.shape[1:])
        for part in (tensors, starts, ends):
            digest.update(np.ascontiguousarray(part))
    told = f"frames={frames};segments={len(spans)};active={sum(e - s for s, e in spans)};tensors={'x'.join(map(str, shape))};tensors_sha256={digest.hexdigest()}"
    return {
        "tensors": stored, "segments": [{"start_ms": s * STEP_MS, "end_ms": e * STEP_MS} for s, e in spans],
        "feature": f"{told};mel=" + ",".join(f"{x:.2f}" for x in total / frames),
    }


def describe(text: str, wanted: tuple[str, ...]) -> dict:
    raw = payload(text)
    media = store(raw)
    back = read_back(media)
    out = {
        "n_bytes": len(text.encode()), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "media": media,
    }
    if {"feature", "tensors", "segments"} & {*wanted}:
        out |= described(np.frombuffer(back, np.uint8))
    return out


def audio_features(docs: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """doc_id and the asked ones of ``COLUMNS``."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    spans = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [describe(t, columns) for t in texts(batch)]
        arrays = [pa.array([f[c] for f in found], kinds.get(COLUMNS[c], spans)) for c in columns]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *columns])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, ", ".join(["doc_id long", *(f"{c} {COLUMNS[c]}" for c in columns)]))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(table(spark, sf_dir, "documents"), (*tuple(COLUMNS)[:7], "segments"))


QUERIES = {"op7_audio": op7_audio}
SQL: dict[str, str] = {}
