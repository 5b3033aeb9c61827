"""Operator 4: texts kept as WAV media columns and described by spectral-peak pairs.

The payload is stored as 8-bit mono samples by the wave module. Reading opens the stored bytes with the
same module, takes short-time Fourier transforms, finds peaks in time and frequency, and pairs each peak
with the next few. Pairs are kept as two arrays: the frame of the first peak and a code of both
frequencies and their distance.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

BLOCK = 192
RATE = 8000
FRAME, HOP = 256, 128
#: The region that a peak tops, and the first bin above the taper's leak of the mean.
TIME_AROUND, BINS_AROUND, LOWEST_BIN = 1, 8, 2
#: Peaks that a peak is paired with, and the farthest in frames.
FAN, REACH = 3, 63
#: Frames transformed at once, so that long texts need bounded memory.
FRAMES_AT_ONCE = 2048
QUIET = 1e-3


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw)), len(raw)


def store(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as to:
        to.setnchannels(1)
        to.setsampwidth(1)
        to.setframerate(RATE)
        to.writeframes(samples)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as of:
        return of.readframes(of.getnframes())


def _highest(values: np.ndarray, around: int, axis: int) -> np.ndarray:
    """The greatest value within so many places to either side."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (around, around)
    values, width = np.pad(values, pad, constant_values=-1.0), 1
    n, part = values.shape[axis] - 2 * around, lambda v, a, b: v[a:b] if axis == 0 else v[:, a:b]
    while 2 * width <= 2 * around + 1:
        last = values.shape[axis]
        values = np.maximum(part(values, 0, last - width), part(values, width, last))
        width *= 2
    rest = 2 * around + 1 - width
    return np.maximum(part(values, 0, n), part(values, rest, rest + n))


def frames_of(samples: bytes) -> np.ndarray:
    """Overlapping frames that cover every sample; the last is filled up with the last sample, as silence would be a jump."""
    signal = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    count = 1 + max(0, -(-(len(signal) - FRAME) // HOP))
    signal = np.pad(signal, (0, FRAME + (count - 1) * HOP - len(signal)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks: no cell within TIME_AROUND frames and BINS_AROUND bins is louder. Equal ones are all peaks."""
    frames, taper = frames_of(samples), np.hanning(FRAME)
    at, bins = [], []
    for lo in range(0, len(frames), FRAMES_AT_ONCE):
        begin, hi = max(0, lo - TIME_AROUND), min(len(frames), lo + FRAMES_AT_ONCE)
        block = frames[begin : hi + TIME_AROUND]
        loud = np.abs(np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * taper, axis=1))[:, LOWEST_BIN:]
        top = (loud > QUIET) & (loud == _highest(_highest(loud, BINS_AROUND, 1), TIME_AROUND, 0))
        t, f = np.nonzero(top[lo - begin : hi - begin])
        at.append(t + lo)
        bins.append(f + LOWEST_BIN)
    return np.concatenate(at), np.concatenate(bins)


def landmarks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded arrays: the first peak's frame, and first bin, second bin and distance as one code; peaks are paired in order of frame and bin."""
    at, bins = peaks(samples)
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = at[k:] - at[:-k] if len(at) > k else np.empty(0, np.int64)
        near = gap <= REACH
        times.append(at[: len(gap)][near])
        codes.append((bins[: len(gap)][near] << 14) | (bins[k:][near] << 6) | gap[near] if len(gap) else gap)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as a WAV file."""

    def run(batches):
        for batch in batches:
            made = [payload(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([store(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of the payload read back and of the stored form, and the landmark arrays times and codes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "times", "codes"]

    def run(batches):
        for batch in batches:
            out = []
            for stored in batch.column(2).to_pylist():
                samples = load(stored)
                times, codes = landmarks(samples)
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), times.astype(np.int32), codes.astype(np.int32)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"
    return media.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """The digests of features() and ``feature``: time:code in hex, comma-joined, by time and then code.

    Null and empty texts give a payload of one block of spaces, whose feature is empty. Each input row gives one
    row, repeated ones too; a null doc_id stays null; other columns are ignored. An empty table gives no rows.
    """
    pairs = F.array_join(F.zip_with("times", "codes", lambda t, c: F.concat(F.lower(F.hex(t)), F.lit(":"), F.lower(F.hex(c)))), ",")
    return features(to_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", pairs.alias("feature"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
