"""Audio columns: polyphase resampling, log-mel filterbanks, energy segments.

A payload is stored losslessly as 8-bit samples of a WAV file. Features are
computed from the samples read back: resampling by 2/3 with a polyphase
windowed-sinc filter, overlapped frames, log-mel energies in fixed-shape Arrow
tensors of PATCH frames with their time spans, and segments between an upper
and a lower energy threshold (hysteresis). Each row is computed by itself, in
blocks of frames, so equal payloads have equal features whatever their batch.

Defined results: an empty text is one unit of padding; a payload shorter than
a frame has one frame padded with silence; nulls count as empty.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, utf8

UNIT = 192
RATE, UP, DOWN = 24_000, 2, 3
TAPS = 8
FRAME, HOP, MELS, PATCH = 256, 128, 24, 16
#: Frames of a block: what a worker holds of a long payload at a time.
BLOCK = 2048
HEADER = 44
SCHEMA = "doc_id {kind}, n_bytes long, media binary, tensors binary, n_frames long, segments array<struct<start:double,end:double>>"


def padded(text: bytes) -> bytes:
    """``text`` and blanks up to a positive multiple of UNIT."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def store(payload: bytes) -> bytes:
    """An 8-bit mono WAV file of the payload."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def load(media: bytes) -> bytes:
    """The samples of such a file, by its own length field."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    n = struct.unpack_from("<I", media, HEADER - 4)[0]
    if riff != b"RIFF" or wave != b"WAVE" or len(media) != HEADER + n:
        raise ValueError("not an 8-bit WAV file of this form")
    return media[HEADER:]


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filter taps of both phases, the frame window and the mel weights."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(UP * TAPS)
    h *= UP / h.sum()
    phases = np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(top), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, top, FRAME // 2 + 1)
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resampled(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Outputs first..last of the payload at 2/3 of its rate; ``first`` is even."""
    phases = constants()[0]
    half = TAPS // 2
    out = np.zeros(last - first, np.float32)
    for p in range(UP):
        count = (last - first - p + 1) // UP
        begin = (first // UP) * DOWN + (p * DOWN) // UP - half + 1
        end = begin + (count - 1) * DOWN + TAPS
        part = np.zeros(max(0, end - begin), np.float32)
        a, b = max(0, begin), min(len(samples), end)
        if b > a:
            part[a - begin : b - begin] = (samples[a:b].astype(np.float32) - 128) / 128
        view = np.lib.stride_tricks.sliding_window_view(part, TAPS)[::DOWN][:count]
        out[p::UP] = view @ phases[p]
    return out


def log_mel(payload: bytes) -> np.ndarray:
    """(frames, MELS) log energies of overlapped frames."""
    _, window, mel = constants()
    samples = np.frombuffer(payload, np.uint8)
    total = len(samples) * UP // DOWN
    frames = max(1, 1 + -(-max(0, total - FRAME) // HOP))
    out = np.empty((frames, MELS), np.float32)
    for k in range(0, frames, BLOCK):
        n = min(BLOCK, frames - k)
        wave = resampled(samples, k * HOP, k * HOP + (n - 1) * HOP + FRAME)
        view = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[::HOP][:n]
        power = np.abs(np.fft.rfft(view * window, axis=1)).astype(np.float32) ** 2
        out[k : k + n] = np.log(power @ mel + np.float32(1e-6))
    return out


def segments(mel: np.ndarray, high: float = 0.5, low: float = -0.5) -> list[tuple[int, int]]:
    """Frame spans: one opens above mean + high sd of the energy and closes below mean + low sd."""
    energy = mel.mean(axis=1, dtype=np.float64)
    level, spread = energy.mean(), energy.std()
    mark = np.where(energy > level + high * spread, 1, np.where(energy < level + low * spread, 0, -1))
    at = np.where(mark >= 0, np.arange(len(mark)), -1)
    at = np.maximum.accumulate(at)
    on = np.where(at >= 0, mark[np.maximum(at, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: fixed-shape (PATCH, MELS) tensors with start and end seconds."""
    count = -(-len(mel) // PATCH)
    whole = np.full((count * PATCH, MELS), np.float32(np.log(1e-6)), np.float32)
    whole[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS])
    values = pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), PATCH * MELS)
    step = HOP * DOWN / UP / RATE
    starts = np.arange(count) * PATCH * step
    ends = np.minimum(np.arange(1, count + 1) * PATCH, len(mel)) * step
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, values), pa.array(starts), pa.array(ends)], names=["log_mel", "start", "end"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def audio(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, tensors, n_frames, segments (seconds): one row for each row."""
    step = HOP * DOWN / UP / RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[list] = [[], [], [], [], []]
                for x in part.column(1):
                    text = x.as_py()
                    media = store(padded(text))
                    mel = log_mel(load(media))
                    found = [{"start": a * step, "end": b * step} for a, b in segments(mel)]
                    for column, value in zip(rows, (len(text), media, tensors(mel), len(mel), found)):
                        column.append(value)
                arrays = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), spans))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n_bytes", "media", "tensors", "n_frames", "segments"])

    kind = df.select(F.col(named(doc_id))).schema[0].dataType.simpleString()
    return df.select(F.col(named(doc_id)).alias("doc_id"), utf8(text).alias("t")).mapInArrow(run, SCHEMA.format(kind=kind))


def feature(tensor_stream: bytes, n_frames: int, n_segments: int) -> str:
    """A short digest of a row's features."""
    return f"{n_frames}:{n_segments}:{hashlib.sha256(tensor_stream).hexdigest()[:16]}"
