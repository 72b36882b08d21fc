"""Language-model scoring by deleted interpolation.

    P(w | p) = l2 * c(p, w) / c(p) + l1 * c(w) / N + l0 / (V + 1)

The weights l depend on a bucket of the context's frequency c(p) and are
learned by expectation-maximisation on held-out counts: a part of the training
documents (DEV_SHARE) is counted apart, and the weights are those that suit its
bigrams best given the other documents' counts. Scores then use the counts of
all training documents. The token before a text's first is the end token, so
c(p) is also the number of tokens that follow p.

Counts grow with the corpus and are neither broadcast nor collected:

1. Documents are dealt into chunks of about CHUNK_BYTES by a hash. Each chunk
   sends its distinct tokens and bigrams (hashes, with its own counts) to
   buckets of the hash range: a frequent word costs one entry a chunk.
2. Each bucket adds up its keys and answers every chunk with their counts.
3. Held-out bigrams meet the counts of both their tokens in two joins and are
   binned (context bucket and quarter powers of two of both ratios), a table
   whose size does not follow the corpus; EM runs on it.
4. Each chunk meets its answers and scores its documents.

Tokens are told apart by 64-bit hashes, bigrams by 40 bits and their bucket.
The number of buckets equals that of chunks, so a bucket's load is bounded as a
chunk's is. Edge cases: a null text is empty and has one token, the end; with
no training documents every probability is 1 / (V + 1) = 1; rows with equal id
and text share a chunk and score alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.common import MIX_B, batch_tokens, crc_bucket, pack, read_table, splitmix, text_bytes, unpack, written

CHUNK_BYTES = 8 << 20
DEV_SHARE = 32
END = np.uint64(0x5851F42D4C957F2D)
KEY_BITS = 40
KEY_MASK = np.uint64((1 << KEY_BITS) - 1)
TOKEN, BIGRAM = 0, 1
PRIOR = (0.1, 0.5, 0.4)
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

REQUEST = "chunk long, kind int, bucket long, keys binary, train binary, dev binary, at binary, left binary, right binary"
ANSWER = "chunk long, kind int, bucket long, train binary, n long, v long, n_main long, v_main long, p array<long>, w array<long>, c_main array<long>, c_dev array<long>"


def _key_bytes(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_key_bytes(blob: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel().astype(np.uint64)


class Chunk:
    """A chunk's tokens (each text's words and one end) with its distinct tokens and bigrams in the order they are sent."""

    def __init__(self, texts: list[bytes], buckets: int) -> None:
        hashes, counts = batch_tokens([t.lower() for t in texts])
        self.lengths = counts + 1
        ends = np.cumsum(self.lengths) - 1
        self.tokens = np.empty(len(hashes) + len(texts), np.uint64)
        words = np.ones(len(self.tokens), bool)
        words[ends] = False
        self.tokens[words], self.tokens[ends] = hashes, END
        self.before = np.concatenate([[END], self.tokens[:-1]]).astype(np.uint64)
        pairs = splitmix(self.before * MIX_B + self.tokens)
        places = [(self._bucket(self.tokens, buckets), self.tokens), (self._bucket(pairs, buckets), pairs & KEY_MASK)]
        self.first, self.inverse, self.bucket, self.keys = [], [], [], []
        for bucket, key in places:
            order = np.lexsort((key, bucket))
            b, k = bucket[order], key[order]
            new = np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])]) if len(b) else np.zeros(0, bool)
            inverse = np.empty(len(order), np.int64)
            inverse[order] = np.cumsum(new) - 1
            self.first.append(order[new])
            self.inverse.append(inverse)
            self.bucket.append(b[new])
            self.keys.append(k[new])

    @staticmethod
    def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
        return ((hashes >> np.uint64(KEY_BITS)) % np.uint64(buckets)).astype(np.int64)

    def per_token(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.lengths)


def _ask(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        texts = text_bytes(table.column("text").combine_chunks())
        found = Chunk(texts, buckets)
        train = found.per_token(np.array(table.column("train").to_pylist(), bool)).astype(float)
        dev = found.per_token(np.array(table.column("dev").to_pylist(), bool)).astype(float)
        rows: list[tuple] = []
        for kind in (TOKEN, BIGRAM):
            size = len(found.keys[kind])
            sums = [np.bincount(found.inverse[kind], weights=x, minlength=size).astype(np.int64) for x in (train, dev)]
            cuts = np.flatnonzero(np.diff(found.bucket[kind], prepend=-1, append=-2))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                keys, first = found.keys[kind][s:e], found.first[kind][s:e]
                held = np.flatnonzero(sums[1][s:e])
                sides = [b"", b"", b""] if kind == TOKEN else [held.astype("<u4").tobytes(), found.before[first[held]].astype("<u8").tobytes(), found.tokens[first[held]].astype("<u8").tobytes()]
                width = 8 if kind == TOKEN else KEY_BITS // 8
                rows.append((chunk, kind, int(found.bucket[kind][s]), _key_bytes(keys, width), pack(sums[0][s:e]), pack(sums[1][s:e]), *sides))
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6)
        names = [x.split()[0] for x in REQUEST.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    blobs = {name: table.column(name).to_pylist() for name in ("keys", "train", "dev", "at", "left", "right")}
    width = 8 if kind == TOKEN else KEY_BITS // 8
    keys = [_from_key_bytes(b, width) for b in blobs["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    train, dev = (np.bincount(inverse, weights=np.concatenate([unpack(b) for b in blobs[x]]), minlength=len(distinct)).astype(np.int64) for x in ("train", "dev"))
    main = train - dev
    held = np.flatnonzero(dev)
    if kind == TOKEN:
        left = right = distinct[held]
    else:
        left, right = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
        for start, at, p, w in zip([0, *ends[:-1].tolist()], blobs["at"], blobs["left"], blobs["right"], strict=True):
            owner = inverse[start + np.frombuffer(at, "<u4").astype(np.int64)]
            left[owner], right[owner] = np.frombuffer(p, "<u8"), np.frombuffer(w, "<u8")
        left, right = left[held], right[held]
    chunks = table.column("chunk").to_pylist()
    answers = [pack(train[i]) for i in np.split(inverse, ends[:-1])]
    rows = len(chunks)
    none = [None] * rows
    totals = [int(train.sum()), int((train > 0).sum()), int(main.sum()), int((main > 0).sum())] if kind == TOKEN else [0] * 4
    columns = [pa.array([*chunks, None], pa.int64()), pa.array([kind] * (rows + 1), pa.int32()), pa.array([bucket] * (rows + 1), pa.int64()), pa.array([*answers, None], pa.binary())]
    columns += [pa.array([*none, t], pa.int64()) for t in totals]
    columns += [pa.array([*none, x], pa.list_(pa.int64())) for x in (left.view(np.int64), right.view(np.int64), main[held], dev[held])]
    return pa.table(columns, names=[x.split()[0] for x in ANSWER.split(", ")])


def held_out_bins(answers: DataFrame, n: int, v: int) -> DataFrame:
    """Held-out bigrams as (context bucket, bin of q2, bin of q1, weight, mean q2, mean q1); q: the estimates to be mixed."""
    dev = answers.filter("chunk is null")
    tokens = dev.filter(F.col("kind") == TOKEN).select(F.explode(F.arrays_zip("p", "c_main")).alias("x")).select(F.col("x.p").alias("t"), F.col("x.c_main").alias("c"))
    pairs = dev.filter(F.col("kind") == BIGRAM).select(F.explode(F.arrays_zip("p", "w", "c_main", "c_dev")).alias("x")).select("x.*")
    seen = pairs.join(tokens.select(F.col("t").alias("p"), F.col("c").alias("c_p")), "p").join(tokens.select(F.col("t").alias("w"), F.col("c").alias("c_w")), "w")
    q2 = F.when(F.col("c_p") > 0, F.col("c_main") / F.col("c_p")).otherwise(0.0)
    q1 = F.col("c_w") / F.lit(float(max(n, 1)))
    spot = lambda q: F.when(q > 0, F.round(4 * F.log2(q))).otherwise(F.lit(1.0)).cast("int")
    bucket = F.when(F.col("c_p") > 0, F.floor(F.log2("c_p")) + 1).otherwise(0).cast("int")
    rated = seen.select(bucket.alias("b"), q2.alias("q2"), q1.alias("q1"), F.col("c_dev").cast("double").alias("n"))
    means = [(F.sum(F.col("n") * F.col(q)) / F.sum("n")).alias(q) for q in ("q2", "q1")]
    return rated.groupBy("b", spot(F.col("q2")).alias("s2"), spot(F.col("q1")).alias("s1")).agg(F.sum("n").alias("n"), *means)


def learn_weights(bins: list[tuple[int, float, float, float]], v: int, rounds: int = 200) -> np.ndarray:
    """Weights (l0, l1, l2) by context bucket, from (bucket, weight, q2, q1); buckets without counts get those of all."""
    last = max([b for b, *_ in bins], default=0)
    weights = np.tile(np.array(PRIOR), (max(last, 0) + 2, 1))

    def fit(rows: list[tuple[int, float, float, float]], start: np.ndarray, contextless: bool) -> np.ndarray:
        n = np.array([r[1] for r in rows])
        q = np.array([(1 / (v + 1), r[3], 0.0 if contextless else r[2]) for r in rows])
        mix = start / start.sum()
        for _ in range(rounds):
            share = mix * q
            share /= share.sum(axis=1, keepdims=True)
            now = n @ share / n.sum()
            if np.abs(now - mix).max() < 1e-9:
                break
            mix = now
        mix = np.maximum(mix, [1e-6, 1e-6, 0.0 if contextless else 1e-6])  # nothing a text holds is impossible
        return mix / mix.sum()

    if bins:
        pooled = fit(bins, np.array(PRIOR), False)
        weights[:] = pooled
        for b in range(last + 1):
            if own := [r for r in bins if r[0] == b]:
                weights[b] = fit(own, pooled, b == 0)
    weights[0, 2] = 0.0  # a context never seen predicts nothing
    weights[0] /= weights[0].sum()
    return weights


def _score(buckets: int, weights: np.ndarray, n: int, v: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = text_bytes(docs.column("text").combine_chunks()) if docs.num_rows else []
        found = Chunk(texts, buckets)
        counts = []
        for kind in (TOKEN, BIGRAM):
            mine = sorted((b, i) for i, (k, b) in enumerate(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), strict=True)) if k == kind)
            blobs = answers.column("train")
            own = [unpack(blobs[i].as_py()) for _, i in mine]
            counts.append(np.concatenate(own)[found.inverse[kind]] if own else np.zeros(0, np.int64))
        c_w, c_pw = counts
        seen = np.sum(c_w[found.tokens == END][:1])
        c_p = np.concatenate([[seen], c_w[:-1]]) if len(c_w) else c_w
        bucket = np.where(c_p > 0, np.frexp(np.maximum(c_p, 1).astype(float))[1], 0)
        mix = weights[np.minimum(bucket, len(weights) - 1)]
        chance = mix[:, 0] / (v + 1) + mix[:, 1] * (c_w / max(n, 1)) + mix[:, 2] * (c_pw / np.maximum(c_p, 1))
        if n == 0:
            chance = np.full(len(c_w), 1.0 / (v + 1))
        base = np.log10((c_w + 0.5) / (n + 0.5 * (v + 1)))
        starts = np.cumsum(found.lengths) - found.lengths
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        columns = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(found.lengths, pa.int64())]
        columns += [pa.array(total((c_w > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(texts), n), pa.int64()), pa.array(total(base)), pa.array(total(np.log10(chance)))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in this block delete their shuffle files as they end; a garbage collection may leave them."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def gather(chunked: DataFrame, buckets: int) -> DataFrame:
    """The answers to every chunk, with the totals and held-out counts of every bucket in rows without a chunk."""
    asked = chunked.groupBy("chunk").applyInArrow(_ask(buckets), REQUEST)
    with shuffles_dropped(chunked.sparkSession):
        return written(asked.groupBy("kind", "bucket").applyInArrow(_answer, ANSWER), "answers")


def score_documents(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every text by a model of those where the condition `held_out` is false."""
    size = docs.agg(F.sum(F.octet_length(f"`{text}`") + 16)).first()[0] or 1
    buckets = max(1, math.ceil(size / chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(buckets)).alias("chunk")
    dev = F.pmod(F.xxhash64(F.lit("dev"), F.col(f"`{doc_id}`")), F.lit(DEV_SHARE)) == 0
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out.alias("held_out"), F.col(f"`{text}`").alias("text"), chunk, (~held_out).alias("train"), (~held_out & dev).alias("dev"))
    answers = gather(rows, buckets)
    n, v, n_main, v_main = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n", "v", "n_main", "v_main")]).first())
    bins = held_out_bins(answers, n_main, v_main).collect()
    weights = learn_weights(sorted((r["b"], r["n"], r["q2"], r["q1"]) for r in bins), v_main)
    told = answers.filter("chunk is not null").select("chunk", "kind", "bucket", "train")
    return rows.select("doc_id", "held_out", "text", "chunk").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(buckets, weights, n, v), SCORED)


def op4_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, crc_bucket("doc_id", 5) == 1)
