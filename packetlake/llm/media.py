"""Media columns: WAV audio, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

RATE, UNIT = 8000, 64
FRAME, HOP = 256, 128
#: Peaks kept of a frame; frames ahead that a peak is paired with; frames transformed at once.
PEAKS, AHEAD, BLOCK = 3, 3, 4096
#: Parts of a magnitude that are told apart.
GRAIN = 64
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_wav(payload: bytes) -> bytes:
    """The bytes as 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> np.ndarray:
    """int16 [frames, PEAKS]: the strongest local maxima of each frame's spectrum, of equal ones the lower, -1 where it has fewer.

    Samples past the end count as silence, so that there is a frame at least. Frames are transformed in
    blocks: memory doesn't grow with the length.
    """
    frames = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    found = []
    for k in range(0, frames, BLOCK):
        n = min(BLOCK, frames - k)
        x = np.zeros((n - 1) * HOP + FRAME, np.float32)
        part = np.frombuffer(samples, np.uint8, min(len(samples) - k * HOP, len(x)), k * HOP)
        x[: len(part)] = part
        x[: len(part)] -= 128
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * _WINDOW, axis=1))
        power = np.rint(power * GRAIN).astype(np.int64)  # whole numbers: builds of the transform differ in last bits only
        inner = power[:, 1:-1]
        inner = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        inner = inner * FRAME + np.where(inner > 0, FRAME - 1 - np.arange(inner.shape[1]), 0)  # of equal ones the lower bin
        best = np.argpartition(inner, -PEAKS, axis=1)[:, -PEAKS:]
        strength = np.take_along_axis(inner, best, axis=1)
        best = np.where(strength > 0, best + 1, -1)
        found.append(-np.sort(-best, axis=1).astype(np.int16))
    return np.concatenate(found)


def peak_pairs(peaks: np.ndarray) -> np.ndarray:
    """Time-coded pairs, ascending: frame << 20 | first bin << 12 | second bin << 4 | frames between."""
    at = np.arange(len(peaks), dtype=np.int64)
    out = []
    for ahead in range(1, AHEAD + 1):
        a, b = peaks[:-ahead].astype(np.int64), peaks[ahead:].astype(np.int64)
        for i in range(PEAKS):
            for j in range(PEAKS):
                both = (a[:, i] >= 0) & (b[:, j] >= 0)
                out.append((at[: len(a)] << 20 | a[:, i] << 12 | b[:, j] << 4 | ahead)[both])
    return np.sort(np.concatenate(out))


def media_columns(docs: DataFrame, keep: bool = True) -> DataFrame:
    """One row per document: its text as a WAV column and what is computed from the samples read back.

    doc_id, n_bytes, media binary (null unless ``keep``), payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, pairs array<long> (null unless ``keep``), feature (number and sha256 of the
    pairs). Null text is empty: 64 zero bytes. Equal texts give equal values; a null doc_id stays null;
    repeated rows each give a row; other columns are ignored.
    """

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            media = write_wav(padded(data))
            back = read_wav(media)
            pairs = peak_pairs(spectral_peaks(back))
            feature = f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()}"
            rows.append((len(data), media if keep else None, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), pairs if keep else None, feature))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *COLUMNS])

    types = ("long", "binary", "long", "string", "long", "long", "string", "array<long>", "string")
    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), convert, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, types, strict=True)))


COLUMNS = ("n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pairs", "feature")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), keep=False).drop("media", "pairs")
