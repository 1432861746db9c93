"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segmentation."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm.common import documents, slices

RATE, DOWN, TAPS = 16000, 2, 24
FRAME, HOP, MELS = 128, 64, 16
#: Frames of a stored tensor; the last one of a clip is filled up with the floor.
TENSOR_FRAMES = 64
#: Frames that are computed at once, which bounds memory for very long clips.
BLOCK_FRAMES = 8192
FLOOR = -1000
#: Energy (a hundredth of a neper above the clip's median) that opens and keeps open a segment.
OPEN_AT, KEEP_AT = 15, -10
#: Bytes of a canonical header of a RIFF file with 8-bit samples, which ``wave`` writes.
HEADER = 44
AUDIO = "doc_id long, n_bytes long, media binary, n_frames long, logmel binary, spans array<struct<start_s: double, end_s: double>>"


@lru_cache
def low_pass() -> np.ndarray:
    n = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS)
    return (h / h.sum()).astype(np.float32)


@lru_cache
def mel_bank(rate: int) -> np.ndarray:
    """Triangles at equal steps of the mel scale over the bins of a frame."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))
    return (bank + 1e-6).T.astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Half the rate: each phase of the filter meets its own phase of the input, so no dropped sample is computed."""
    h, n = low_pass(), (len(samples) + DOWN - 1) // DOWN
    out = np.zeros(n, np.float32)
    for phase in range(DOWN):
        own = np.append(np.float32(0), samples[DOWN - phase :: DOWN]) if phase else samples[::DOWN]
        part = np.convolve(own, h[phase::DOWN])[:n]
        out[: len(part)] += part
    return out


def log_mel(samples: np.ndarray, rate: int) -> np.ndarray:
    """Hundredths of nepers as int16, a row per frame; frames overlap by half."""
    if len(samples) < FRAME:
        samples = np.append(samples, np.zeros(FRAME - len(samples), np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window, out = np.hanning(FRAME).astype(np.float32), []
    for start in range(0, len(frames), BLOCK_FRAMES):
        power = np.abs(np.fft.rfft(frames[start : start + BLOCK_FRAMES] * window, axis=1)).astype(np.float32) ** 2
        out.append(np.maximum(FLOOR, np.rint(100 * np.log(power @ mel_bank(rate) + 1e-4))).astype(np.int16))
    return np.concatenate(out)


def segments(mel: np.ndarray, rate: int) -> list[tuple[float, float]]:
    """Time spans whose energy rose over OPEN_AT and has stayed over KEEP_AT, against the clip's median."""
    energy = mel.mean(axis=1)
    energy = energy - np.median(energy)
    keep = energy >= KEEP_AT
    change = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    peaks = np.concatenate([[0], np.cumsum(energy >= OPEN_AT)])
    return [(float(a * HOP / rate), float((b * HOP + FRAME - HOP) / rate)) for a, b in change.reshape(-1, 2) if peaks[b] > peaks[a]]


def tensors(mel: np.ndarray) -> bytes:
    """Fixed-shape Arrow tensors: a stream with one column of TENSOR_FRAMES x MELS values, and their time spans."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), FLOOR, np.int16)
    full[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))
    start = np.arange(n) * TENSOR_FRAMES * HOP * DOWN / RATE
    end = np.minimum(np.arange(1, n + 1) * TENSOR_FRAMES, len(mel)) * HOP * DOWN / RATE
    batch = pa.RecordBatch.from_arrays([column, pa.array(start), pa.array(end)], names=["logmel", "start_s", "end_s"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def stored(payload: bytes) -> bytes:
    """The payload as a mono RIFF file of unsigned 8-bit samples."""
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return sink.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def audio_features(docs: DataFrame, multiple: int = 64) -> DataFrame:
    """Store every text of ``docs`` (``doc_id``, ``text``) as audio and compute features from the stored bytes.

    The samples are the UTF-8 bytes, filled with bytes 0 to a positive multiple of ``multiple``. ``logmel`` holds
    fixed-shape tensors with their time spans as an Arrow stream, ``spans`` the segments. Null text counts as empty; very long texts are stored whole; one row
    per input row, repeated rows and rows without id too; equal texts give equal values; an empty table gives no rows; no shuffle; other columns are ignored. See ``AUDIO``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
        for batch in slices(batches, 64):
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = stored(raw + bytes(max(multiple, -(-len(raw) // multiple) * multiple) - len(raw)))
                samples = (np.frombuffer(read_back(media), np.uint8).astype(np.float32) - 128) / 128
                mel = log_mel(resample(samples), RATE // DOWN)
                spans = [{"start_s": a, "end_s": b} for a, b in segments(mel, RATE // DOWN)]
                rows.append((len(raw), media, len(mel), tensors(mel), spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], names=["doc_id", "n_bytes", "media", "n_frames", "logmel", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, AUDIO)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored audio: the payload is what stands after the file's header."""
    audio = audio_features(documents(spark, sf_dir))
    payload = F.expr(f"substring(media, {HEADER + 1}, octet_length(media) - {HEADER})")
    return audio.select(
        "doc_id", "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("logmel="), F.lower(F.hex(F.crc32("logmel")))), F.concat(F.lit("segments="), F.size("spans")),
                    F.concat(F.lit("active="), F.format_string("%.3f", F.aggregate("spans", F.lit(0.0), lambda acc, x: acc + x.end_s - x.start_s)))).alias("feature"),
    )
