"""Audio columns: media bytes, log-mel features as fixed-shape tensors, and time spans of activity.

Each row is worked on by itself with NumPy inside an Arrow pass, so nothing is shuffled and equal rows give equal
results whatever stands beside them. Samples are resampled by a polyphase filter, cut into overlapped frames, turned
into log-mel bands, and segmented by frame energy with hysteresis.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

RATE_IN, RATE_OUT = 16_000, 8_000
UNIT = 64
FRAME, HOP, BANDS = 256, 128, 40
#: A tensor holds so many frames; the last one of a recording is filled up with FLOOR.
TENSOR_FRAMES = 64
FLOOR = -10.0
#: Frames, or output samples, worked on at once.
CHUNK = 4096
#: Activity begins above the first level and ends below the second, in units of the recording's own spread of energy.
RISE, FALL = 0.5, -0.25
OUT_SCHEMA = "n_bytes long, media binary, payload binary, n_frames long, tensors binary, spans array<struct<start_ms: long, end_ms: long>>"


@cache
def resampler(up: int, down: int, taps: int = 16) -> np.ndarray:
    """The phases of a windowed-sinc low-pass filter: row p is what the p-th output of each up outputs takes its inputs by."""
    width = taps * up
    t = np.arange(width) - (width - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(width)
    phases = h.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down of its rate: output n takes phase n * down mod up of the inputs around n * down div up."""
    g = np.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x
    phases = resampler(up, down)
    taps = phases.shape[1]
    padded = np.pad(x, (taps // 2, taps))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    n = -(-len(x) * up // down)
    out = np.empty(n, dtype=np.float32)
    for first in range(up):  # outputs first, first + up, ... have one phase and inputs that lie down apart
        mine = out[first::up]
        at = first * down // up
        for k in range(0, len(mine), CHUNK):
            part = mine[k : k + CHUNK]
            part[:] = windows[at + down * k : at + down * (k + len(part)) : down][: len(part)] @ phases[first * down % up]
    return out


@cache
def mel_filters(rate: int) -> np.ndarray:
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(0.0), mel(rate / 2), BANDS + 2) / 2595.0) - 1.0)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


def frames_of(x: np.ndarray) -> np.ndarray:
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    padded = np.pad(x, (0, (n - 1) * HOP + FRAME - len(x)))
    return np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]


def log_mel(frames: np.ndarray, rate: int) -> np.ndarray:
    if len(frames) > CHUNK:
        return np.concatenate([log_mel(frames[k : k + CHUNK], rate) for k in range(0, len(frames), CHUNK)])
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32) ** 2
    return np.maximum(np.log10(np.maximum(power @ mel_filters(rate), 1e-10)), FLOOR).astype(np.float32)


def active_spans(frames: np.ndarray, rate: int) -> list[tuple[int, int]]:
    """Milliseconds (start, end) of runs of frames that begin above the upper level and last until one is below the lower level."""
    energy = np.concatenate([np.log10(np.maximum(part.var(axis=1), 1e-10)) for part in (frames[k : k + CHUNK] for k in range(0, len(frames), CHUNK))])
    spread = energy.std()
    if spread == 0:
        return []
    z = (energy - energy.mean()) / spread
    mark = np.where(z >= RISE, 1, np.where(z < FALL, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    change = np.diff(np.concatenate([[0], on, [0]]))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    ms = lambda frame: int(frame) * HOP * 1000 // rate
    return [(ms(s), ms(e - 1) + FRAME * 1000 // rate) for s, e in zip(starts, ends, strict=True)]


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE_IN)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def to_ipc(tensors: np.ndarray, n_frames: int) -> bytes:
    """An Arrow stream of tensors as a fixed_shape_tensor column log_mel, with the milliseconds (start_ms, end_ms) that each spans."""
    first = np.arange(len(tensors), dtype=np.int64) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, n_frames) - 1
    ms = lambda frame: frame * HOP * 1000 // RATE_OUT
    batch = pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(tensors), pa.array(ms(first)), pa.array(ms(last) + FRAME * 1000 // RATE_OUT)], names=["log_mel", "start_ms", "end_ms"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_ipc(stored: bytes) -> pa.Table:
    """What to_ipc wrote: log_mel (fixed_shape_tensor of TENSOR_FRAMES x BANDS), start_ms, end_ms."""
    return pa.ipc.open_stream(stored).read_all()


def featurise(text: str | None) -> dict:
    data = (text or "").encode("utf-8")
    media = to_wav(data + bytes(-len(data) % UNIT if data else UNIT))
    payload = from_wav(media)
    x = (np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    frames = frames_of(resample(x, RATE_OUT, RATE_IN))
    mel = log_mel(frames, RATE_OUT)
    blocks = np.full((-(-len(mel) // TENSOR_FRAMES) * TENSOR_FRAMES, BANDS), FLOOR, dtype=np.float32)
    blocks[: len(mel)] = mel
    return {"n_bytes": len(data), "media": media, "payload": payload, "n_frames": len(mel), "tensors": to_ipc(blocks.reshape(-1, TENSOR_FRAMES, BANDS), len(mel)), "spans": [{"start_ms": s, "end_ms": e} for s, e in active_spans(frames, RATE_OUT)]}


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, media (WAV, 8-bit mono), payload (read back from media), n_frames, tensors, spans.

    The payload is the text in UTF-8 (null: empty), filled with zero bytes to a positive multiple of 64. tensors is
    an Arrow stream with a fixed_shape_tensor column of TENSOR_FRAMES x BANDS log-mel floats and the time span of each
    tensor; from_ipc reads it. An empty table gives no rows, a very long text is worked on in chunks. A recording of even
    energy has no spans. Repeated rows give repeated results; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [featurise(t) for t in part.column("text").to_pylist()]
                columns = {"id": part.column("id")}
                columns |= {c: pa.array([m[c] for m in made], t) for c, t in (("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("n_frames", pa.int64()), ("tensors", pa.binary()))}
                columns["spans"] = pa.array([m["spans"] for m in made], pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])))
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"id {kind.simpleString()}, {OUT_SCHEMA}").withColumnRenamed("id", id_col)
