"""Media columns: audio stored as WAV, and features as fixed-shape Arrow tensors with time spans.

A clip is 8-bit unsigned mono PCM in a RIFF container. From the stored bytes
alone the operator decodes the samples and computes:

* polyphase resampling by a rational factor UP / DOWN: one windowed-sinc
  low-pass filter, split into UP branches, of which each output sample uses one;
* overlapped log-mel filterbanks: Hann frames of FRAME samples every HOP
  samples, power spectrum, triangular mel bands, natural logarithm;
* hysteresis energy segmentation: a segment opens at a frame whose energy
  reaches the upper threshold and closes after one that falls below the lower
  threshold; both lie relative to the clip's own energy range.

The frames are cut into tensors of a fixed shape (TENSOR_FRAMES, MELS), the
last filled up with silence, and stored as one Arrow IPC stream for each
clip: columns start_s, end_s (the tensor's time span), n_frames, and tensor
(arrow.fixed_shape_tensor of int16, in steps of 1 / SCALE). Segments are a second stream of spans.

Frames are worked through in fixed blocks; a clip itself is held whole, at about
16 bytes a sample with its resampled signal. Every block has the same shape for
any clip, so equal clips give equal features in any batch. Edge cases: a null clip counts as empty, and an empty
clip still has one tensor; repeated rows give equal values; an empty table
gives no rows; only the key and the clip's column are read, so that other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.llm.common import in_small_batches, read_table, text_bytes

RATE = 8000
UP, DOWN = 3, 4
TAPS = 8  # of each branch
FRAME, HOP, FFT = 150, 60, 256  # 25 ms and 10 ms at the resampled 6 kHz
MELS = 24
TENSOR_FRAMES = 64
BLOCK_FRAMES = 4096
SCALE = 1024  # steps of a stored log-mel value
FLOOR = 1e-6
OPEN_SHARE, CLOSE_SHARE = 0.6, 0.4
PAD_BYTE = 255
PAD_UNIT = 576
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono PCM; an odd number of samples gets the container's pad byte."""
    pad = len(samples) % 2
    head = HEADER.pack(b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono PCM file; chunks other than fmt and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is supported")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("damaged WAVE file")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def lowpass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Branches x taps of a Hann-windowed sinc at the lower of both Nyquist rates."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    sinc = np.sinc(n / max(up, down)) * np.hanning(up * taps + 2)[1:-1]
    branches = sinc.reshape(taps, up).T
    return (branches / branches.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, branches: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """ceil(n * up / down) samples; output m uses branch (m * down) % up at input (m * down) // up.

    Computed for `up` outputs, that is `down` inputs, at a time: output phase p
    of every group is a strided dot product with one branch.
    """
    taps = branches.shape[1]
    out_n = -(-len(samples) * up // down)
    groups = -(-out_n // up)
    padded = np.zeros(groups * down + taps + down, np.float32)
    padded[taps // 2 : taps // 2 + len(samples)] = samples
    out = np.zeros((groups, up), np.float32)
    for p in range(up):
        branch, first = branches[p * down % up], p * down // up
        for k in range(taps):  # elementwise, so that each sample's sum has one order
            out[:, p] += branch[taps - 1 - k] * padded[first + k : first + k + groups * down : down]
    return out.ravel()[:out_n]


def mel_bands(rate: float = RATE * UP / DOWN, mels: int = MELS, fft: int = FFT) -> np.ndarray:
    """Frequencies x bands of triangles evenly spaced on the mel scale."""
    to_mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(40), to_mel(rate / 2), mels + 2) / 2595) - 1)
    hz = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    rise = (hz - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


BRANCHES = lowpass()
BANDS = mel_bands()
HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(audio: np.ndarray) -> tuple[np.ndarray, int]:
    """Frames x bands, filled up with silence to whole tensors, and how many of the frames lie in the clip (at least one).

    Bands are computed for TENSOR_FRAMES frames at a time, so that a frame's
    values do not depend on what else is in memory.
    """
    n = max(1, -(-(len(audio) - (FRAME - HOP)) // HOP))
    whole = -(-n // TENSOR_FRAMES) * TENSOR_FRAMES
    out = np.empty((whole, MELS), np.float32)
    for low in range(0, whole, BLOCK_FRAMES):
        size = min(BLOCK_FRAMES, whole - low)
        piece = np.zeros((size - 1) * HOP + FRAME, np.float32)
        part = audio[low * HOP : low * HOP + len(piece)]
        piece[: len(part)] = part
        frames = np.lib.stride_tricks.as_strided(piece, (size, FRAME), (4 * HOP, 4), writeable=False) * HANN
        spectrum = np.fft.rfft(frames, FFT, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        bands = np.matmul(power.reshape(-1, TENSOR_FRAMES, FFT // 2 + 1), BANDS).reshape(size, MELS)
        out[low : low + size] = np.log(np.maximum(bands, FLOOR))
    return out, n


def segments(energy: np.ndarray, open_share: float = OPEN_SHARE, close_share: float = CLOSE_SHARE) -> np.ndarray:
    """[start, end) frames of the active segments, by hysteresis between two thresholds.

    A frame's state is that of the last frame before it, itself included, which
    lay outside the band between the thresholds; before any such frame it is off.
    """
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-3:
        return np.empty((0, 2), np.int64)
    loud = energy >= low + open_share * (high - low)
    decided = np.flatnonzero(loud | (energy < low + close_share * (high - low)))
    state = loud[decided]
    turns = np.flatnonzero(state[1:] != state[:-1]) + 1
    edges = decided[turns].tolist()
    if len(state) and state[0]:
        edges.insert(0, int(decided[0]))
    if len(edges) % 2:
        edges.append(len(energy))
    return np.array(edges, np.int64).reshape(-1, 2)


TENSOR_TYPE = pa.fixed_shape_tensor(pa.int16(), (TENSOR_FRAMES, MELS))
TENSOR_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32()), ("tensor", TENSOR_TYPE)])
SEGMENT_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64())])


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def clip_features(media: bytes) -> tuple[bytes, bytes, int, int]:
    """The tensor stream, the segment stream, and how many frames and segments there are."""
    samples, rate = decode_wav(media)
    signal = np.frombuffer(samples, np.uint8).astype(np.float32) / 128 - 1
    mel, n = log_mel(resample(signal, BRANCHES))
    step = HOP * DOWN / (UP * rate)
    count = len(mel) // TENSOR_FRAMES
    fixed = np.rint(mel * SCALE).astype(np.int16)
    starts = np.arange(count) * TENSOR_FRAMES
    ends = np.minimum(starts + TENSOR_FRAMES, n)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(fixed.ravel()), TENSOR_FRAMES * MELS)
    tensors = pa.ExtensionArray.from_storage(TENSOR_TYPE, storage)
    batch = pa.RecordBatch.from_arrays([pa.array(starts * step), pa.array(ends * step), pa.array((ends - starts).astype(np.int32)), tensors], schema=TENSOR_SCHEMA)
    spans = segments(mel[:n].mean(axis=1, dtype=np.float64)) * step
    found = pa.RecordBatch.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], schema=SEGMENT_SCHEMA)
    return _ipc(batch), _ipc(found), n, len(spans)


def read_tensors(stream: bytes) -> pa.Table:
    """The table of a stored stream, tensors as fixed-shape tensor arrays."""
    return pa.ipc.open_stream(stream).read_all()


FEATURES_TYPE = T.StructType(
    [T.StructField("tensors", T.BinaryType()), T.StructField("segments", T.BinaryType()), T.StructField("n_frames", T.LongType()), T.StructField("n_segments", T.LongType())]
)


@F.arrow_udf(FEATURES_TYPE)
def audio_features(media: pa.Array) -> pa.Array:
    """Features of stored clips; a null clip counts as one without samples."""
    rows = [clip_features(m if m else encode_wav(b"")) for m in media.to_pylist()]
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FEATURES_TYPE.names)


def payload_of(text: bytes, unit: int = PAD_UNIT) -> bytes:
    """The text's bytes, filled up with 255 to a positive multiple of the unit."""
    return text + bytes([PAD_BYTE]) * (max(1, -(-len(text) // unit)) * unit - len(text))


@F.arrow_udf(T.BinaryType())
def text_as_wav(text: pa.Array) -> pa.Array:
    return pa.array([encode_wav(payload_of(t)) for t in text_bytes(text)], pa.binary())


DIGEST_TYPE = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
    ]
)


@F.arrow_udf(DIGEST_TYPE)
def stored_digest(media: pa.Array) -> pa.Array:
    """What the stored clip holds, read back through the decoder."""
    payloads = [decode_wav(m)[0] for m in media.to_pylist()]
    columns = [
        pa.array([len(p) for p in payloads], pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
        pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
    ]
    return pa.StructArray.from_arrays(columns, names=DIGEST_TYPE.names)


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = in_small_batches(read_table(spark, sf_dir, "documents")).select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    stored = docs.select("doc_id", n_bytes, text_as_wav("text").alias("media"))
    read = stored.select("*", stored_digest("media").alias("d"), audio_features("media").alias("f"))
    digest = F.concat_ws(":", F.col("f.n_frames"), F.col("f.n_segments"), F.sha2("f.tensors", 256), F.sha2("f.segments", 256))
    return read.select(
        "doc_id",
        "n_bytes",
        "d.*",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        digest.alias("feature"),
        "f.n_frames",
        "f.n_segments",
    )
