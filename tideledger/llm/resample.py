"""Quality classifier by importance resampling.

Two bag-of-hashed-n-grams models over the same buckets, one of target text
(documents labelled good) and one of raw text (all documents), give every
document a log importance weight log p_target(x) - log p_raw(x). Adding Gumbel
noise keyed by a hash of the document and keeping the k largest sums draws k
documents without replacement in proportion to their weights.

The target model is fitted on at most `max_target` labelled documents, those of
smallest id hash; the raw model, the weights and the selection cover every
document. Models are `buckets` numbers whatever the corpus size. The k-th
largest key is found by counting keys in ever finer ranges, so selection
neither sorts globally nor gathers rows.

Edge cases: a null or empty text has no n-grams and weight zero; equal rows get
equal keys, and rows that tie at the k-th key are all kept; unlabelled tables
make both models equal, so that the draw is uniform; an empty table gives no
rows; input columns that clash with an added column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.common import MIX_B, batch_tokens, byte_groups, checkpointed, in_small_batches, read_table, splitmix, text_bytes

BUCKETS = 10_000
MAX_TARGET = 20_000
SMOOTHING = 1.0
BATCH_BYTES = 1 << 20
SEED = 42


def gram_buckets(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all lower-cased unigrams and bigrams, and the text each belongs to."""
    hashes, counts = batch_tokens([t.lower() for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    same = owner[1:] == owner[:-1]
    pairs = splitmix(hashes[:-1] * MIX_B + hashes[1:])[same]
    grams = np.concatenate([hashes, pairs]) % np.uint64(buckets)
    return grams.astype(np.int64), np.concatenate([owner, owner[1:][same]])


def _count_grams(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            texts, target = text_bytes(batch.column(0)), np.array(batch.column(1).to_pylist(), bool)
            for low, high in byte_groups(texts, BATCH_BYTES):
                grams, owner = gram_buckets(texts[low:high], buckets)
                sums[0] += np.bincount(grams, minlength=buckets)
                sums[1] += np.bincount(grams[target[low:high][owner]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "raw", "target"])

    return count


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """Ids of at most max_target documents labelled good, by order of their hash."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)


def fit(docs: DataFrame, targets: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    marked = in_small_batches(docs).select("doc_id", F.col(f"`{text}`").alias("t")).join(F.broadcast(targets.withColumn("target", F.lit(True))), "doc_id", "left")
    counted = marked.select("t", F.coalesce("target", F.lit(False))).mapInArrow(_count_grams(buckets), "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, a, b in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket], target[bucket] = a, b
    if not target.any():
        return np.zeros(buckets)
    # both models lean on the raw frequencies, so that rare buckets say little
    lean = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets)
    share = SMOOTHING * buckets
    return np.log((target + share * lean) / (target.sum() + share)) - np.log(lean)


def _scorer(model: np.ndarray):
    """Sums in an order fixed by the document alone, so equal texts weigh the same in any batch."""

    @F.arrow_udf("struct<n_grams: long, log_weight: double>")
    def score(text: pa.Array) -> pa.Array:
        texts = text_bytes(text)
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        steps = np.round(model * 2**20).astype(np.int64)  # whole numbers add up alike in any order
        for low, high in byte_groups(texts, BATCH_BYTES):
            grams, owner = gram_buckets(texts[low:high], len(model))
            n[low:high] = np.bincount(owner, minlength=high - low)
            np.add.at(total[low:high], owner, steps[grams])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total / 2**20)], names=["n_grams", "log_weight"])

    return score


def gumbel(seed: int) -> Column:
    """Gumbel noise from a hash of the document's id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int, ranges: int = 4096) -> float | None:
    """The k-th largest of the column `key`, or None if there are fewer; exact up to the last bit."""
    bounds = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if bounds[0] is None or k >= bounds[2]:
        return None
    low, high, above = bounds[0], bounds[1], 0
    while low < high:
        width = (high - low) / ranges
        if low + width <= low or width == 0:
            break
        spot = F.least(F.floor((F.col("key") - low) / width), F.lit(ranges - 1)).cast("int")
        counts = keys.filter(F.col("key").between(low, high)).groupBy(spot.alias("spot")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for row in sorted(counts, key=lambda r: -r["spot"]):
            if above + row["n"] >= k:
                low, high = row["a"], row["b"]
                break
            above += row["n"]
        if above + row["n"] == k:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, text: str = "text", seed: int = SEED, max_target: int = MAX_TARGET, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_grams, log_weight, key) of the drawn documents.

    share: how many to draw of all; by default the share of labelled documents that are good.
    """
    if share is None:
        share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    model = fit(docs, target_ids(labels, max_target), text, buckets)
    scored = docs.select("doc_id", _scorer(model)(F.col(f"`{text}`")).alias("s")).select("doc_id", "s.*")
    keys = checkpointed(scored.withColumn("key", F.col("log_weight") + gumbel(seed)))
    cut = kth_largest(keys, round(share * keys.count()))
    return keys if cut is None else keys.filter(F.col("key") >= cut)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read_table(spark, sf_dir, "labels"))
