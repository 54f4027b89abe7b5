"""Audio columns: texts stored as 8-bit WAV, and the features of such a column.

Features: polyphase resampling to the target rate, overlapped log-mel filterbanks, and segments of
raised energy found with two thresholds (hysteresis). They come as fixed-shape patches of frames
with their time spans: rows for Spark, and for each document an Arrow stream whose tensor column has
the extension type of fixed shape, which Spark's own types lack.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow

STORED_RATE, TARGET_RATE = 12_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 40
#: Frames of a patch: the tensors have the shape (PATCH, MELS).
PATCH = 32
#: Bytes of tensors that a batch of the query's result holds, but for one longer document.
RESULT_BYTES = 4 << 20
#: Frames that are transformed at once.
BLOCK = 4_096
#: Filter taps of each phase.
TAPS = 16
#: Deviations from the mean energy (in decibels) where a segment begins, and where it ends.
RISE, FALL = 0.5, -0.25


def pad(data: bytes, unit: int = 64) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(data) // unit) * unit)
    return data.ljust(size, b"\0")


def wav(samples: bytes, rate: int = STORED_RATE) -> bytes:
    """One channel of unsigned 8-bit PCM."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def read_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate; ValueError for other formats or a truncated file."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit PCM is read")
        elif kind == b"data":
            if not rate or at + 8 + size > len(media):
                raise ValueError("truncated WAV file")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@cache
def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc for the higher of the two rates' common multiple, by phase."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    return (np.sinc(t * cut) * np.hanning(n + 2)[1:-1] * cut * up).astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """``x`` at another rate: each output phase has its own short filter, and only wanted outputs are computed."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    if up == down:
        return x
    taps = low_pass(up, down).reshape(TAPS, up)[::-1]  # of each phase, last tap first
    many = -(-len(x) * up // down)
    out = np.zeros(many, np.float32)
    before = np.pad(x, (TAPS - 1, TAPS))
    windows = np.lib.stride_tricks.sliding_window_view(before, TAPS)
    for r in range(min(up, many)):
        part = out[r::up]
        phase, first = r * down % up, r * down // up
        own, filt = windows[first::down][: len(part)], np.ascontiguousarray(taps[:, phase])
        for i in range(0, len(part), BLOCK):
            part[i : i + BLOCK] = own[i : i + BLOCK] @ filt
    return out


@cache
def mel_bank(rate: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, as (FFT / 2 + 1, MELS)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    centre = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    at = np.arange(FFT // 2 + 1)[:, None] * rate / FFT
    rise, fall = (at - centre[:-2]) / (centre[1:-1] - centre[:-2]), (centre[2:] - at) / (centre[2:] - centre[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS): overlapped frames, the last one filled up with silence."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, (frames - 1) * HOP + FRAME - len(x)))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((frames, MELS), np.float32)
    for i in range(0, frames, BLOCK):
        power = np.abs(np.fft.rfft(view[i : i + BLOCK] * _HANN, FFT)).astype(np.float32) ** 2
        out[i : i + BLOCK] = np.log(power @ mel_bank(rate) + 1e-6)
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that begin above the high threshold and last until energy falls below the low one."""
    energy = 10 * np.log10(np.exp(mel).mean(1))
    energy = (energy - energy.mean()) / max(energy.std(), 1e-6)
    mark = np.where(energy >= RISE, 1, np.where(energy < FALL, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(on, prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


@dataclass
class Features:
    mel: np.ndarray
    spans: list[tuple[int, int]]
    rate: int

    def patches(self) -> Iterator[tuple[float, float, np.ndarray]]:
        """(start second, end second, tensor), the last tensor filled up with zeros."""
        for i in range(0, len(self.mel), PATCH):
            own = self.mel[i : i + PATCH]
            full = np.zeros((PATCH, MELS), np.float32)
            full[: len(own)] = own
            yield i * HOP / self.rate, ((i + len(own) - 1) * HOP + FRAME) / self.rate, full

    def digest(self) -> str:
        """Frames, segments and their frames, mean and deviation of each fourth band."""
        mean, deviation = self.mel.mean(0)[::4], self.mel.std(0)[::4]
        numbers = [f"{x:.2f}" for x in (*mean.tolist(), *deviation.tolist())]
        return ":".join([str(len(self.mel)), str(len(self.spans)), str(sum(b - a for a, b in self.spans)), *numbers])


def features_of(media: bytes, target: int = TARGET_RATE) -> tuple[bytes, Features]:
    """The samples as read back, and their features."""
    samples, rate = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x, rate, target)
    mel = log_mel(x, target)
    return samples, Features(mel, segments(mel), target)


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``media``: each text's UTF-8 bytes, padded, as a WAV file.

    Null and empty texts become 64 silent samples; very long texts are one file; repeated rows each
    have theirs; an empty table stays empty. A ``media`` column of ``docs`` is replaced, all others
    stay, whatever their names.
    """
    own = [c for c in docs.columns if c.lower() != "media"]
    # plain names inside, so that no column of docs can clash
    inner = [f"c{i}" for i in range(len(own))]
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, inner)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    schema = docs.select(*[f"`{c}`" for c in own]).schema.add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = pa.array([wav(pad(x)) for x in batch.column("raw").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in inner), media], [*own, "media"])

    return map_arrow(out, run, schema)


def patch_batch(found: Features) -> pa.RecordBatch:
    """A row per patch: patch, start_s, end_s, active (share of frames in segments), log_mel (tensors)."""
    on = np.zeros(len(found.mel), bool)
    for a, b in found.spans:
        on[a:b] = True
    start, end, tensors = zip(*found.patches())
    active = [float(on[i : i + PATCH].mean()) for i in range(0, len(on), PATCH)]
    flat = pa.ListArray.from_arrays(np.arange(len(tensors) + 1, dtype=np.int32) * (PATCH * MELS), pa.array(np.concatenate(tensors).ravel()))
    columns = [pa.array(range(len(tensors)), pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64()), pa.array(active, pa.float64()), tensor_column(flat)]
    return pa.RecordBatch.from_arrays(columns, ["patch", "start_s", "end_s", "active", "log_mel"])


def patch_digest(patches: pa.RecordBatch) -> str:
    """Count of the patches, checksum of their spans and shares, checksum of their tensors."""
    spans = np.stack([patches.column(c).to_numpy() for c in ("start_s", "end_s", "active")])
    tensors = np.ascontiguousarray(patches.column("log_mel").to_numpy_ndarray())
    return f"{len(tensors)}:{zlib.crc32(spans.astype('<f8').tobytes()):08x}:{zlib.crc32(tensors.astype('<f4', copy=False)):08x}"


def tensor_stream(patches: pa.RecordBatch) -> bytes:
    """An Arrow stream of a document's patches, the tensors as a fixed-shape extension column."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, patches.schema) as out:
        out.write_batch(patches)
    return sink.getvalue().to_pybytes()


def read_stream(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(stored).read_next_batch()


def audio_features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per patch: ``key``, patch, start_s, end_s, active (share of frames in segments), log_mel.

    ``log_mel`` holds PATCH x MELS floats in row order, as Spark has no tensors; ``tensor_column``
    makes the Arrow tensor column of it. Null media give no rows, and bytes that are no 8-bit WAV an
    error; repeated rows each give theirs, a null key stays null; very long media give as many
    patches as they hold; an empty table none. Other columns of ``media`` are ignored.
    """
    source = media.select(F.col(key).alias("key"), F.col(column).alias("media")).where("media is not null")
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stored in zip(batch.column("key"), batch.column("media").to_pylist()):
                patches = patch_batch(features_of(stored)[1])
                n = patches.num_rows
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (PATCH * MELS), patches.column("log_mel").storage.flatten())
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, k.type), *patches.columns[:-1], flat], ["key", *patches.schema.names])

    out = map_arrow(source, run, f"key {kind}, patch int, start_s double, end_s double, active double, log_mel array<float>")
    return out.withColumnRenamed("key", key)


def audio_tensors(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """``key, n_patches, tensors``: a row per row of ``media``, the patches as one ``tensor_stream``.

    Null media give no rows, repeated rows each theirs, very long media one long stream; a null key
    stays null, an empty table stays empty. Batches hold about ``RESULT_BYTES`` of tensors.
    """
    source = media.select(F.col(key).alias("key"), F.col(column).alias("media")).where("media is not null")
    field = source.schema["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, rows = 0, 0, []
            for i, stored in enumerate(batch.column("media").to_pylist()):
                patches = patch_batch(features_of(stored)[1])
                rows.append((patches.num_rows, tensor_stream(patches)))
                held += len(rows[-1][1])
                if held >= RESULT_BYTES or i == batch.num_rows - 1:
                    n, streams = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(rows)), pa.array(n, pa.int32()), pa.array(streams, pa.binary())], ["key", "n_patches", "tensors"])
                    first, held, rows = i + 1, 0, []

    return map_arrow(source, run, f"key {field.dataType.simpleString()}, n_patches int, tensors binary").withColumnRenamed("key", key)


def tensor_column(flat: pa.ListArray) -> pa.FixedShapeTensorArray:
    """The patches of ``audio_features`` as an Arrow column of (PATCH, MELS) tensors."""
    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten(), PATCH * MELS))


OP10_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_patches int"


def op10_media_audio(docs: DataFrame) -> DataFrame:
    """Stores each text as WAV, reads it back and describes what was read; one row per row of ``docs``.

    Each document's patches are written as an Arrow stream (``tensor_stream``: fixed-shape tensors
    with their time spans, as ``audio_tensors`` returns them); ``feature`` is made of what is read
    back from that stream and of the frames' statistics. Null and empty texts store 64 silent samples; equal texts give equal
    values whatever the batch, repeated rows each theirs; a very long text is transformed block by
    block; a null doc_id stays null; an empty table stays empty; further columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).alias("raw")
    stored = encode_media(docs.select(F.col("doc_id").cast("long"), F.octet_length(raw).cast("long").alias("n_bytes"), raw), "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_patches"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "n_bytes", "media"))):
                back, found = features_of(media)
                patches = read_stream(tensor_stream(patch_batch(found)))
                rows.append((doc_id, n_bytes, len(back), sha(back), zlib.crc32(back[-64:]), len(media), sha(media), f"{found.digest()}:{patch_digest(patches)}", patches.num_rows))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), run, OP10_SCHEMA)
