"""Media columns: WAV samples, short-time Fourier spectra, spectral-peak pair fingerprints.

``store_wav`` turns payload bytes into 8-bit mono WAV files held in a binary column;
``fingerprint_wav`` reads such files with the wave module and returns the samples and
their fingerprints as two time-coded arrays (anchor frame, packed pair).

Defined cases: null or empty text is a payload of 64 zero bytes; a null media value
gives null samples and empty arrays; equal payloads give equal values; rows repeat as
they came; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

RATE, PAD = 8000, 64
FRAME, HOP = 512, 256  #: samples of a Fourier frame, and between frames
BANDS = 4  #: frequency bands; each gives its loudest bin
SPAN = 4  #: frames of a block in which a band has one peak
FAN = 3  #: later peaks that an anchor is paired with
CHUNK = 2048  #: frames transformed at once


def payload_of(text: bytes) -> bytes:
    """The bytes, then zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % PAD if text else PAD)


def wav_of(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return w.readframes(w.getnframes())


_window = np.hanning(FRAME).astype(np.float32)
_edges = np.linspace(1, FRAME // 2 + 1, BANDS + 1).astype(int)


def framed(samples: bytes) -> np.ndarray:
    """Frames of all samples; silence around them, so that the window's ends, which are zero, hide no sample."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    x = np.pad(x, (HOP, HOP + -len(x) % HOP))
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, by time: in each block of frames the loudest bin of each band."""
    frames = framed(samples)
    at, bins = [], []
    for k in range(0, len(frames), CHUNK):
        power = np.abs(np.fft.rfft(frames[k : k + CHUNK] * _window, axis=1))
        blocks = -(-len(power) // SPAN)
        power = np.pad(power, ((0, blocks * SPAN - len(power)), (0, 0)), constant_values=-1).reshape(blocks, SPAN, -1)
        for lo, hi in zip(_edges[:-1], _edges[1:]):
            best = power[:, :, lo:hi].reshape(blocks, -1).argmax(axis=1)
            at.append(k + np.arange(blocks) * SPAN + best // (hi - lo))
            bins.append(lo + best % (hi - lo))
    at, bins = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((bins, at))
    return at[order], bins[order]


def pairs(at: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor frame and ``bin1 << 20 | bin2 << 10 | frames between`` for each peak and the FAN peaks after it."""
    t, code = [], []
    for k in range(1, FAN + 1):
        t.append(at[:-k])
        code.append(bins[:-k] << 20 | bins[k:] << 10 | np.minimum(at[k:] - at[:-k], 1023))
    t, code = np.concatenate(t), np.concatenate(code)
    order = np.lexsort((code, t))
    return t[order].astype(np.int32), code[order].astype(np.int32)


def _store(rows):
    for b in C.cut(rows, 2000, 16 << 20):
        raw = C.texts(b.column(1))
        media = pa.array([wav_of(payload_of(x)) for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), media], ["doc_id", "n_bytes", "media"])


def store_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a WAV file of 8-bit samples; n_bytes is its length without padding."""
    return C.id_text(docs, id_col, text_col).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _read(rows):
    for b in C.cut(rows, 2000, 16 << 20):
        media, found = b.column(2).to_pylist(), []
        samples = [None if m is None else samples_of(m) for m in media]
        for s in samples:
            found.append(pairs(*peaks(s)) if s is not None else (np.zeros(0, np.int32),) * 2)
        ends = np.cumsum([0, *(len(t) for t, _ in found)], dtype=np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1)]
        feature = [f"{len(t)}:{hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest()}" for t, c in found]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(samples, pa.binary()), *lists, pa.array(feature, pa.string())], ["doc_id", "n_bytes", "media", "samples", "fp_time", "fp_code", "feature"])


def fingerprint_wav(media: DataFrame) -> DataFrame:
    """Adds samples (read back from the stored form), fp_time, fp_code and feature, a digest of the two, to (doc_id, n_bytes, media)."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, media binary, samples binary, fp_time array<int>, fp_code array<int>, feature string")


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Digests of the stored form of every row of ``documents``, of what is read back, and the fingerprint.

    Null text is a payload of 64 zero bytes; null ids stay null; rows repeat as they came; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = fingerprint_wav(store_wav(docs))
    return got.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "fp_time",
        "fp_code",
    )
