"""Media columns: samples stored losslessly, and audio features of them as fixed-shape tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 64, 16_000
#: Features: rate after resampling, frame and hop in samples, mel bands, samples worked on at once.
TARGET, FRAME, HOP, MELS, CHUNK = 8_000, 256, 128, 32, 1 << 20
SCHEMA = "doc_id long, n_bytes long, media binary, tensor binary, segments array<struct<begin_s: double, end_s: double>>, feature string"


def payload(text: bytes | None) -> bytes:
    """The bytes, then zeros up to a positive multiple of 64."""
    text = text or b""
    return text + bytes((-len(text)) % BLOCK or (0 if text else BLOCK))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE, one channel, 8 bits a sample; the samples stay as they are."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and their rate; other chunks are skipped."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def lowpass(up: int, down: int, taps: int = 16) -> np.ndarray:
    """A windowed sinc for resampling by up/down, a row for each of the up phases."""
    n = 2 * taps * max(up, down) // max(1, min(up, down)) * up
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    return (up * h / h.sum()).reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase: output k takes phase (k * down) % up of the filter at input (k * down) // up; inputs
    beyond the ends are 0."""
    h = lowpass(up, down)
    taps, n = h.shape[1], len(x) * up // down
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(up):
        k = np.arange(first, n, up)
        if len(k):
            step = windows[k[0] * down // up :: down][: len(k)]
            out[k] = sum(step[:, i] * h[(first * down) % up, taps - 1 - i] for i in range(taps))
    return out


def mel_bank(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, as columns over the bins of the spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW, _BANK = np.hanning(FRAME).astype(np.float32), mel_bank(TARGET, FRAME, MELS)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames of FRAME samples every HOP, the last padded with 0: log of 1e-6 + mel energies."""
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for at in range(0, n, CHUNK // FRAME):
        spectrum = np.fft.rfft(frames[at : at + CHUNK // FRAME] * _WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) / FRAME
        out[at : at + CHUNK // FRAME] = np.log(1e-6 + np.einsum("fb,bm->fm", power, _BANK, optimize=True))
    return out


def segments(energy: np.ndarray, high: float = 0.5, low: float = -0.5) -> list[tuple[int, int]]:
    """Spans [begin, end) of frames: one opens at a level above mean + high standard deviations and
    closes where it falls below mean + low of them."""
    mean, sd = float(energy.mean()), float(energy.std())
    state = np.where(energy >= mean + high * sd, 1, np.where(energy < mean + low * sd, -1, 0)) if sd > 1e-6 else np.zeros(len(energy), int)
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (known >= 0) & (state[known] > 0)
    step = np.flatnonzero(np.diff(np.r_[False, on, False].astype(int)))
    return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))


def as_tensor(mel: np.ndarray, frames: int = 16) -> bytes:
    """Arrow IPC stream: blocks of frames x MELS as a fixed-shape tensor column (the last block is
    padded with its last frame) beside each block's time span in seconds."""
    n = -(-len(mel) // frames)
    blocks = np.concatenate([mel, np.repeat(mel[-1:], n * frames - len(mel), 0)]).reshape(n, frames, MELS)
    begin = np.arange(n) * (frames * HOP / TARGET)
    end = np.minimum(begin + ((frames - 1) * HOP + FRAME) / TARGET, ((len(mel) - 1) * HOP + FRAME) / TARGET)
    batch = pa.record_batch({"mel": pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(blocks)), "begin_s": begin, "end_s": end})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]], str]:
    """Log-mel frames, segments in seconds and a short digest of them."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    g = np.gcd(rate, TARGET)
    mel = log_mel(resample(x, TARGET // g, rate // g))
    found = segments(mel.mean(axis=1))
    spans = [(a * HOP / TARGET, ((b - 1) * HOP + FRAME) / TARGET) for a, b in found]
    feature = f"frames={len(mel)};segments={len(spans)};seconds={sum(b - a for a, b in found) * HOP / TARGET:.3f};mel=" + ",".join(f"{v:.1f}" for v in mel.mean(axis=0, dtype=np.float64)[:8] + 0.0)
    return mel, spans, feature


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAVE), tensor (Arrow IPC), segments, feature of documents(doc_id,
    text). Null and empty texts are 64 zero samples; each row stands alone, in any order; the
    features are computed from the samples read back from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin in range(0, len(ids), 64):
                out = []
                for doc_id, text in zip(ids[begin : begin + 64], texts.slice(begin, 64).to_pylist(), strict=True):
                    media = to_wav(payload(text))
                    mel, spans, feature = features(*from_wav(media))
                    out.append({"doc_id": doc_id, "n_bytes": len(text or b""), "media": media, "tensor": as_tensor(mel), "segments": [{"begin_s": a, "end_s": b} for a, b in spans], "feature": feature})
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tensor", pa.binary()), ("segments", pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))), ("feature", pa.string())])


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes say, read back, a row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            back = [from_wav(x)[0] for x in batch.media]
            yield pd.DataFrame({
                "doc_id": batch.doc_id, "n_bytes": batch.n_bytes, "payload_bytes": [len(x) for x in back], "payload_sha256": [hashlib.sha256(x).hexdigest() for x in back], "tail_crc32": [zlib.crc32(x[-BLOCK:]) for x in back],
                "media_bytes": [len(x) for x in batch.media], "media_sha256": [hashlib.sha256(x).hexdigest() for x in batch.media], "feature": batch.feature,
            })

    return media.select("doc_id", "n_bytes", "media", "feature").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
