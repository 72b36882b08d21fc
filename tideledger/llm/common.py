"""Helpers shared by the corpus operators: reading, shared work folders, vectorised tokenising."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where work goes if the session names no folder and runs on one machine, as in tests.
FALLBACK_CHECKPOINT_DIR = "/tmp/tideledger-checkpoints"

#: Rows that Python workers get at a time, so that their memory follows this and not the session's default.
BATCH_ROWS = 2000

#: Bytes of text handled at a time by the vectorised tokeniser.
SEGMENT_BYTES = 1 << 20

#: Spark and Java regular expression for one whitespace byte of the corpus contracts.
SPACE = r"\x20\x09-\x0D"

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
POWER_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in spark.checkpoint.dir; set one only where none is named and all work is on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or FALLBACK_CHECKPOINT_DIR)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable copy in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared checkpoint folder and read it again; see `discard`."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `written` made, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and checkpoints that only finished work needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(df: DataFrame, most: int) -> bool:
    """Whether there are at most so many rows, by counting no more than that."""
    return df.limit(most + 1).count() <= most


def packed(docs: DataFrame) -> DataFrame:
    """Every row as one struct `row`, beside which added columns cannot clash with the input's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands Python workers at most BATCH_ROWS rows at a time."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def id_text(column: str) -> Column:
    """doc_id as text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of doc_id's text, modulo a small number."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(modulus)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is the empty text."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def byte_groups(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `limit` bytes; a longer value is a range of its own."""
    start = size = 0
    for i, value in enumerate(values):
        if i > start and size + len(value) > limit:
            yield start, i
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield start, len(values)


def pack(values: np.ndarray) -> bytes:
    """Small whole numbers, compressed; those from 255 on are kept apart."""
    big = np.flatnonzero(values >= 255)
    small = np.minimum(values, 255).astype(np.uint8).tobytes()
    body = len(values).to_bytes(8, "little") + len(big).to_bytes(8, "little") + small + big.astype("<u4").tobytes() + values[big].astype("<u8").tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    body = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, big = int.from_bytes(body[:8], "little"), int.from_bytes(body[8:16], "little")
    values = np.frombuffer(body, np.uint8, n, 16).astype(np.int64)
    values[np.frombuffer(body, "<u4", big, 16 + n)] = np.frombuffer(body, "<u8", big, 16 + n + 4 * big)
    return values


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


IS_SPACE = _is_space()
BYTE_VALUE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(POWER_BASE))


class _Powers:
    """Powers of POWER_BASE and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = cls._table(POWER_BASE, n)
            cls.down = cls._table(pow(POWER_BASE, -1, 1 << 64), n)
        return cls.up, cls.down

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of POWER_BASE and of its inverse."""
    return _Powers.upto(n)


def _segment_tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * down[starts]), starts


def token_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every whitespace-separated token, and the byte each begins at.

    Equal tokens have equal hashes wherever they stand; the work is split at
    whitespace so that memory follows SEGMENT_BYTES and not the text's length.
    """
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + SEGMENT_BYTES)
        if end < len(text):
            raw = np.frombuffer(text, np.uint8, end - at, at)
            last = np.flatnonzero(IS_SPACE[raw])
            if len(last):
                end = at + int(last[-1]) + 1
            else:  # one token longer than a segment
                rest = np.frombuffer(text, np.uint8, len(text) - end, end)
                after = np.flatnonzero(IS_SPACE[rest])
                end += int(after[0]) if len(after) else len(rest)
        h, s = _segment_tokens(np.frombuffer(text, np.uint8, end - at, at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def batch_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of several texts, in order, and how many tokens each text has."""
    joined = b"\n".join(texts)
    hashes, starts = token_hashes(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)
