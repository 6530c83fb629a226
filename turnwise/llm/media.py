"""Media columns: bytes stored as audio, and audio features as fixed-shape tensors with time spans.

Storing: any bytes become the samples of an 8-bit mono WAV file, zero-padded to a positive multiple of 64, so they can
be read back bit for bit. Features: polyphase resampling, overlapped log-mel filterbanks, and segmentation of the
frame energy with hysteresis (a segment starts above one level and ends below a lower one).

Media are written to a Parquet table in the shared folder and read back from there. Features are one Arrow pass over
it, whose results are stored, too: a row holds an Arrow stream with a fixed-shape tensor and a time span for each window of some files, and a second
stream with the time spans of their loud segments; digests are made of what is read back from these. A file is worked on in blocks,
so memory is a few times the largest file; nothing is shuffled.

Defined results: null counts as empty, and an empty payload is 64 zero bytes; bytes that are no WAV file of this kind
give a null payload and features; equal media give equal values, whatever batch they come in; repeated rows are kept;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Scratch, small, stored, text_or_empty

RATE = 16_000
UNIT = 64
#: The rate after resampling is RATE * UP / DOWN, 6 kHz: three phases.
UP, DOWN, TAPS = 3, 8, 16
FFT, HOP, MELS = 256, 128, 32
#: Frames of one tensor.
FRAMES = 64
#: Tensors are rounded to this and stored as 16-bit floats, which hold it exactly. Bytes of tensors in one stored row, unless one file has more.
STEP = 1 / 64
CHUNK_BYTES = 4 << 20
#: Levels between the quiet and the loud tenth of the frames at which a segment starts and ends.
START, STOP = 0.6, 0.4
BLOCK = 4096

DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_windows long, n_segments long, seconds double, loud_seconds double"
CHUNK_SCHEMA = "files array<struct<doc_id:bigint,n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,seconds:double>>, windows binary, segments binary"
FEATURE_SCHEMA = "doc_id long, window int, start_s double, end_s double, voiced double, tensor array<float>"


def payload(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``UNIT``."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM WAV file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + 8 + len(samples)) + b"WAVE" + form + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> tuple[bytes, int] | None:
    """(samples, rate) of an 8-bit mono PCM WAV file; None if it is something else."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt " and size >= 16:
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                return None
        elif kind == b"data":
            return None if rate is None or at + 8 + size > len(media) else (media[at + 8 : at + 8 + size], rate)
        at += 8 + size + size % 2
    return None


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass filter, dealt out to ``up`` phases of ``taps`` coefficients."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Rational resampling by a polyphase filter: each output sample meets only its own phase's coefficients."""
    if up == down:
        return x.astype(np.float32)
    h = _phases(up, down, taps)
    n_out = -(-len(x) * up // down)
    half = taps // 2
    padded = np.concatenate([np.zeros(half, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    windows = sliding_window_view(padded, taps)
    out = np.empty(n_out, np.float32)
    for p in range(min(up, n_out)):
        at = np.arange(p, n_out, up) * down
        first, phase = at[0] // up, at[0] % up
        out[p::up] = windows[first::down][: len(at)] @ h[phase]
    return out


@cache
def _mel(rate: float, fft: int, mels: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (bins, mels)."""
    to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, to_mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)
    fall = (edges[2:] - f[:, None]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: float, fft: int = FFT, hop: int = HOP, mels: int = MELS) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, their energy in dB); frames overlap by ``fft - hop`` samples and cover the whole signal."""
    n = max(1, -(-max(0, len(x) - fft) // hop) + 1)
    padded = np.zeros((n - 1) * hop + fft, np.float32)
    padded[: len(x)] = x
    frames = sliding_window_view(padded, fft)[::hop]
    window, bank = np.hanning(fft).astype(np.float32), _mel(rate, fft, mels)
    out, energy = np.empty((n, mels), np.float32), np.empty(n, np.float32)
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK] * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        out[at : at + BLOCK] = np.log10(power @ bank + np.float32(1e-8))
        energy[at : at + BLOCK] = 10 * np.log10((part * part).mean(axis=1) + 1e-10)
    return out, energy


def segments(energy: np.ndarray, start: float = START, stop: float = STOP) -> list[tuple[int, int]]:
    """Spans [first frame, end frame) of the loud parts, with hysteresis between the two levels."""
    quiet, loud = np.quantile(energy, [0.1, 0.9])
    if loud - quiet < 1e-6:
        return []
    on, off = energy >= quiet + start * (loud - quiet), energy < quiet + stop * (loud - quiet)
    at = np.arange(len(energy))
    last = np.maximum.accumulate(np.where(on | off, at, -1))
    state = np.where(last >= 0, on[last], False).astype(np.int8)
    edge = np.diff(np.concatenate([[0], state, [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def features(samples: bytes, rate: int = RATE, frames: int = FRAMES) -> tuple[np.ndarray, list[tuple[int, int]], float]:
    """(tensors of shape (windows, frames, mels), loud spans in frames, seconds per frame)."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    slow = RATE * UP / DOWN if rate == RATE else rate * UP / DOWN
    mel, energy = log_mel(resample(x), slow)
    n = -(-len(mel) // frames)
    tensor = np.full((n * frames, MELS), -8.0, np.float32)
    tensor[: len(mel)] = mel
    return tensor.reshape(n, frames, MELS), segments(energy), HOP / slow


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as a WAV file."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in small(batches):
            raw = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([to_wav(payload(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """A row per window of each of ``media`` (``doc_id``, ``media``): its time span, loud share and flat tensor.

    Every tensor has the shape (``FRAMES``, ``MELS``); :func:`tensor_column` makes it an Arrow fixed-shape tensor.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in small(batches):
            for doc_id, item in zip(batch.column(0), batch.column(1), strict=True):
                got = from_wav(item.as_py() or b"")
                if got is None:
                    continue
                tensor, spans, step = features(*got)
                n = len(tensor)
                loud = np.zeros(n * FRAMES)
                for a, b in spans:
                    loud[a:b] = 1
                start = np.arange(n) * FRAMES * step
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * FRAMES * MELS), pa.array(tensor.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(start), pa.array(start + FRAMES * step), pa.array(loud.reshape(n, FRAMES).mean(axis=1)), flat],
                    names=["doc_id", "window", "start_s", "end_s", "voiced", "tensor"],
                )

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, FEATURE_SCHEMA)


def tensor_array(tensor: np.ndarray):
    """(windows, frames, mels) numbers as an Arrow array of fixed-shape tensors."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.from_numpy_dtype(tensor.dtype), tensor.shape[1:])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensor.ravel()), int(np.prod(tensor.shape[1:])))
    return pa.ExtensionArray.from_storage(kind, flat)


def read_tensors(array) -> np.ndarray:
    """The numbers of an Arrow array of fixed-shape tensors."""
    return array.to_numpy_ndarray()


def write_stream(columns: dict) -> bytes:
    """Arrow columns as a compressed Arrow stream."""
    import pyarrow as pa

    table = pa.table(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_stream(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().combine_chunks()


def window_streams(files: list[tuple[np.ndarray, list[tuple[int, int]], float]]) -> tuple[bytes, bytes]:
    """The features of some files (tensors, loud spans in frames, seconds per frame) as two Arrow streams: windows, with their
    place in the list, time span and tensor; and loud segments, with place and time span."""
    import pyarrow as pa

    tensors = np.concatenate([t for t, _, _ in files] or [np.zeros((0, FRAMES, MELS))])
    rounded = (np.rint(tensors / STEP) * STEP).astype(np.float16)
    file = np.repeat(np.arange(len(files)), [len(t) for t, _, _ in files])
    start = np.concatenate([np.arange(len(t)) * FRAMES * step for t, _, step in files] or [np.zeros(0)])
    length = np.repeat([FRAMES * step for _, _, step in files], [len(t) for t, _, _ in files])
    windows = {"file": pa.array(file, pa.int32()), "start_s": pa.array(start), "end_s": pa.array(start + length), "tensor": tensor_array(rounded)}
    spans = [(i, a * step, b * step) for i, (_, found, step) in enumerate(files) for a, b in found]
    loud = {n: pa.array([x[k] for x in spans], t) for k, (n, t) in enumerate((("file", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())))}
    return write_stream(windows), write_stream(loud)


def stored_features(media: DataFrame) -> DataFrame:
    """``CHUNK_SCHEMA`` rows of some of ``media`` (``doc_id``, ``n_bytes``, ``media``) each: what was read back from the files, and their features as Arrow streams."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "seconds"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        facts: list[tuple] = []
        made: list[tuple] = []
        size = 0

        def chunk():
            structs = pa.StructArray.from_arrays([pa.array([f[i] for f in facts], k) for i, k in enumerate(kinds)], names=names)
            files = pa.ListArray.from_arrays(pa.array([0, len(facts)], pa.int32()), structs)
            streams = window_streams(made)
            return pa.RecordBatch.from_arrays([files, *[pa.array([x], pa.binary()) for x in streams]], names=["files", "windows", "segments"])

        for batch in small(batches):
            for doc_id, n_bytes, item in zip(*[batch.column(i).to_pylist() for i in (0, 1)], batch.column(2), strict=True):
                data = item.as_py() or b""
                got = from_wav(data)
                whole = (len(data), hashlib.sha256(data).hexdigest())
                if got is None:
                    facts.append((doc_id, n_bytes, None, None, None, *whole, None))
                    made.append((np.zeros((0, FRAMES, MELS), np.float32), [], 0.0))
                else:
                    samples, rate = got
                    facts.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), *whole, len(samples) / rate))
                    made.append(features(samples, rate))
                size += made[-1][0].nbytes // 2
                if size >= CHUNK_BYTES:
                    yield chunk()
                    facts.clear()
                    made.clear()
                    size = 0
        if facts:
            yield chunk()

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", F.col("media").cast("binary").alias("media")).mapInArrow(run, CHUNK_SCHEMA)


def tensor_column(table):
    """A pyarrow table or batch of :func:`audio_features` with ``tensor`` as a fixed-shape tensor array."""
    import pyarrow as pa

    column = table.column("tensor")
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    made = [pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(p.flatten(), FRAMES * MELS)) for p in parts]
    fields = [kind if f.name == "tensor" else f.type for f in table.schema]
    columns = [pa.chunked_array(made, kind) if f.name == "tensor" else table.column(f.name) for f in table.schema]
    return pa.table(columns, pa.schema([pa.field(f.name, t) for f, t in zip(table.schema, fields, strict=True)]))


def feature_digests(chunks: DataFrame) -> DataFrame:
    """``DIGEST_SCHEMA`` rows of every file of :func:`stored_features`.

    ``feature`` is the SHA-256 of the file's tensors and of its loud segments' time spans in milliseconds, as they are read from the stored streams.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
        for batch in batches:
            for facts, windows, segments in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                told, loud = read_stream(windows.as_py()), read_stream(segments.as_py())
                tensors = read_tensors(told.column("tensor").chunk(0)) if told.num_rows else np.zeros((0, FRAMES, MELS), np.float16)
                first = np.searchsorted(told.column("file").to_numpy(), np.arange(len(facts) + 1))
                spans = np.column_stack([loud.column(c).to_numpy() for c in ("start_s", "end_s")])
                first_span = np.searchsorted(loud.column("file").to_numpy(), np.arange(len(facts) + 1))
                rows = []
                for i, f in enumerate(facts):
                    own, heard = tensors[first[i] : first[i + 1]], spans[first_span[i] : first_span[i + 1]]
                    digest = hashlib.sha256(own.astype("<f2").tobytes() + np.rint(heard * 1000).astype("<i8").tobytes()).hexdigest()
                    known = f["payload_bytes"] is not None
                    tail = (digest, len(own), len(heard), f["seconds"], round(float((heard[:, 1] - heard[:, 0]).sum()), 6)) if known else (None,) * 5
                    rows.append((f["doc_id"], f["n_bytes"], f["payload_bytes"], f["payload_sha256"], f["tail_crc32"], f["media_bytes"], f["media_sha256"], *tail))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return chunks.select("files", "windows", "segments").mapInArrow(run, DIGEST_SCHEMA)


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from each of ``media`` (``doc_id``, ``n_bytes``, ``media``) and from its stored features, as digests: see ``DIGEST_SCHEMA``."""
    return feature_digests(stored(stored_features(media), "media-features"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store each document as a media file, read the stored files back and give their digests and features'.

    The media are deleted when the features are stored, and these when the digests are; to keep them, write :func:`to_media` to a table of one's own.
    """
    with Scratch(docs.sparkSession) as scratch:
        with Scratch(docs.sparkSession) as first:
            chunks = scratch.stored(stored_features(first.stored(to_media(docs), "media")), "media-features")
        return scratch.kept(feature_digests(chunks), "media-digests")
