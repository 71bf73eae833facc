"""Media columns: WAV samples, short-time spectra and peak-pair fingerprints.

The bytes of a text, padded with zero bytes to a positive multiple of 64, become the samples
of an 8-bit mono WAV file made and read with the ``wave`` module. Frames of ``WINDOW`` samples,
``HOP`` apart, are windowed and transformed; the strongest bins of each frame are its peaks,
and each peak pairs with the peaks of the next ``REACH`` frames. A fingerprint is (frame of
the first peak, code of both bins and their distance in time).

Frames are worked off in blocks of ``BLOCK``, so memory stays bounded for texts of any length.
A null text counts as empty: 64 zero bytes, whose flat spectrum has no peaks. Equal texts have
equal values; nothing depends on the row's place.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, RATE = 64, 8000
WINDOW, HOP, PEAKS, REACH, BLOCK = 256, 128, 3, 2, 4096
_SHAPE = np.hanning(WINDOW).astype(np.float32)


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bins of each frame, strongest first, -1 where a frame has fewer: frames x PEAKS."""
    wave_form = np.frombuffer(samples, np.uint8)
    short = max(0, WINDOW - len(wave_form)) or -(len(wave_form) - WINDOW) % HOP
    wave_form = np.concatenate([wave_form, np.full(short, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(wave_form, WINDOW)[::HOP]
    found = np.empty((len(frames), PEAKS), np.int64)
    for at in range(0, len(frames), BLOCK):
        part = (frames[at : at + BLOCK].astype(np.float32) - 128) * _SHAPE
        # whole numbers, so that rounding in the last bits cannot reorder ties
        power = np.rint(np.abs(np.fft.rfft(part, axis=1))[:, 1:-1]).astype(np.int64)
        top = power > np.maximum(np.pad(power, ((0, 0), (1, 0)))[:, :-1], np.pad(power, ((0, 0), (0, 1)))[:, 1:])
        power[~top] = 0
        bins = np.argsort(-power, axis=1, kind="stable")[:, :PEAKS]
        found[at : at + BLOCK] = np.where(np.take_along_axis(power, bins, 1) > 0, bins, -1)
    return found


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, codes), by frame and then by code; a code is bin * 2^16 + partner's bin * 2^8 + distance."""
    found = peaks(samples)
    times, codes = [], []
    for gap in range(1, REACH + 1):
        if len(found) <= gap:
            break
        first, second = found[:-gap, :, None], found[gap:, None, :]
        both = (first >= 0) & (second >= 0)
        frame = np.broadcast_to(np.arange(len(found) - gap)[:, None, None], both.shape)
        times.append(frame[both])
        codes.append(((first << 16) + (second << 8) + gap)[both])
    if not times:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def summary(times: np.ndarray, codes: np.ndarray) -> str:
    """Fingerprint count, the first three time-coded ones and a digest of all."""
    whole = hashlib.sha256(np.stack([times, codes]).astype("<i8").tobytes()).hexdigest()[:32]
    head = ",".join(f"{t}@{c:06x}" for t, c in zip(times[:3], codes[:3], strict=True))
    return f"{len(times)}|{head}|{whole}"


#: Fingerprints that a worker holds before it gives rows on: some 8 MB.
HELD = 1_000_000
MEDIA = "struct<wav:binary,n_samples:long,time:array<int>,code:array<int>>"
FACTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def add_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with a column of the stored WAV and its fingerprints as time-coded arrays."""

    def make(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            stored = to_wav(payload(t))
            samples = from_wav(stored)
            times, codes = fingerprints(samples)
            rows.append((stored, len(samples), times.astype(np.int32), codes.astype(np.int32)))
        return pd.DataFrame(rows, columns=["wav", "n_samples", "time", "code"])

    return docs.withColumn(into, F.pandas_udf(make, MEDIA)(F.col(text)))


def media_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, sizes, digests and the feature, computed from the stored bytes, and the fingerprints as ``times`` and ``codes``.

    A worker gives its rows on as soon as it holds ``HELD`` fingerprints, so long texts do not add up in memory.
    """
    names = [c.split()[0] for c in FACTS.split(", ")]

    def measure(text: str | None) -> tuple:
        stored = to_wav(payload(text))
        back = from_wav(stored)
        times, codes = fingerprints(back)
        size = len((text or "").encode("utf-8", "surrogatepass"))
        return size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), summary(times, codes), times.astype(np.int32), codes.astype(np.int32)

    def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        facts = [pa.array([r[i] for r in rows], pa.string() if isinstance(rows[0][i], str) else pa.int64()) for i in range(len(names))]
        arrays = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (-2, -1)]
        return pa.RecordBatch.from_arrays([ids, *facts, *arrays], ["_id", *names, "times", "codes"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, held = [], 0, 0
            for i, t in enumerate(batch.column(1)):
                rows.append(measure(t.as_py()))
                held += len(rows[-1][-1])
                if held >= HELD or i + 1 == batch.num_rows:
                    yield packed(batch.column(0).slice(start, len(rows)), rows)
                    rows, start, held = [], i + 1, 0

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(make, f"_id {kind}, {FACTS}, times array<int>, codes array<int>").withColumnRenamed("_id", doc_id)
