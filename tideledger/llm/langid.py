"""Language identification by a byte convolutional network, in numpy.

Texts are cut into windows of a fixed number of UTF-8 bytes. Bytes are embedded,
filters of several widths run over them, each filter's maximum over the window
is its feature, and a softmax over the features gives language probabilities.
A document's prediction is the language of the largest mean probability over
all of its windows, and its score is that mean. For prediction the embedding
and the filters are multiplied out into tables by byte and by pair of bytes.

Training uses only text and language of training documents: every window of at
most `max_docs` different texts a language, those of smallest hash, in at most
`max_langs` languages, the most frequent ones; this bounds the rows that the
driver holds. Prediction covers every window of every document.

Edge cases: a text that is null or has no letter is `und` with score 0; so is
every text if no training document has a language; equal texts get equal
predictions; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.common import byte_groups, crc_bucket, in_small_batches, read_table, text_bytes

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Texts of a language, and languages, that the network is trained on.
MAX_DOCS = 400
MAX_LANGS = 256
MARGIN = 1.25
EPOCHS = 4
BATCH = 64
RATE = 2e-3
BATCH_BYTES = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def windows(text: bytes, size: int = WINDOW_BYTES) -> np.ndarray:
    """The whole text as rows of `size` bytes, the last one filled up with spaces."""
    rows = max(1, -(-len(text) // size))
    return np.frombuffer(text.ljust(rows * size), np.uint8).reshape(rows, size)


class ByteCnn:
    """Embedding, convolutions of several widths with ReLU, maximum over positions, softmax."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.weights = {"embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
            self.weights[f"shift{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.weights["out_shift"] = np.zeros(len(labels), np.float32)

    def _patches(self, x: np.ndarray, width: int) -> np.ndarray:
        """Every run of `width` embedded bytes, laid out as one row each."""
        n, size, depth = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(n, size * depth), width * depth, axis=1)
        return view[:, ::depth].reshape(-1, width * depth)

    def features(self, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        x, out = self.weights["embedding"][rows], []
        for w in WIDTHS:
            patches = self._patches(x, w)
            scores = (patches @ self.weights[f"filter{w}"]).reshape(len(rows), -1, FILTERS)
            best = scores.max(axis=1) + self.weights[f"shift{w}"]
            if keep is not None:
                keep[w] = patches.reshape(len(rows), -1, patches.shape[1]), scores.argmax(axis=1), best > 0
            out.append(np.maximum(best, 0))
        return np.concatenate(out, axis=1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter sums by the first pair of bytes (all widths), by a third byte (width 3), by a second pair (width 4)."""
        taps = {w: np.einsum("be,wef->wbf", self.weights["embedding"], self.weights[f"filter{w}"].reshape(w, EMBEDDING, FILTERS)) for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        first = np.concatenate([pair(taps[w][0], taps[w][1]) for w in WIDTHS], axis=1)
        return first, taps[3][2], pair(taps[4][2], taps[4][3])

    def pooled(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The same numbers as features(), from the tables; widths 2, 3 and 4."""
        first, third, second = tables
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        sums = np.take(first, pairs, axis=0)
        sums[:, :-1, FILTERS : 2 * FILTERS] += np.take(third, rows[:, 2:], axis=0)
        sums[:, :-2, 2 * FILTERS :] += np.take(second, pairs[:, 2:], axis=0)
        sums[:, -1:, FILTERS : 2 * FILTERS] = -np.inf  # places where the filter would not fit
        sums[:, -2:, 2 * FILTERS :] = -np.inf
        return np.maximum(sums.max(axis=1) + np.concatenate([self.weights[f"shift{w}"] for w in WIDTHS]), 0)

    def probabilities(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], block: int = 64) -> np.ndarray:
        """One row per window; blocks have a fixed number of rows, so that a window's result does not depend on its neighbours."""
        out = np.empty((len(rows), len(self.labels)), np.float64)
        for low in range(0, len(rows), block):
            part = rows[low : low + block]
            filled = part if len(part) == block else np.concatenate([part, np.full((block - len(part), rows.shape[1]), 32, np.uint8)])
            logits = (self.pooled(filled, tables) @ self.weights["out"] + self.weights["out_shift"]).astype(np.float64)
            chances = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[low : low + block] = (chances / chances.sum(axis=1, keepdims=True))[: len(part)]
        return out

    def gradients(self, rows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        features = self.features(rows, kept)
        logits = features @ self.weights["out"] + self.weights["out_shift"]
        wrong = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong /= wrong.sum(axis=1, keepdims=True)
        wrong[np.arange(len(rows)), truth] -= 1
        wrong /= len(rows)
        grads = {"out": features.T @ wrong, "out_shift": wrong.sum(axis=0), "embedding": np.zeros_like(self.weights["embedding"])}
        back = wrong @ self.weights["out"].T
        sample = np.arange(len(rows))[:, None]
        for k, w in enumerate(WIDTHS):
            patches, place, active = kept[w]
            flow = back[:, k * FILTERS : (k + 1) * FILTERS] * active
            chosen = patches[sample, place]  # rows x filters x inputs of the filter
            grads[f"filter{w}"] = np.einsum("nfd,nf->df", chosen, flow)
            grads[f"shift{w}"] = flow.sum(axis=0)
            into = (flow[:, :, None] * self.weights[f"filter{w}"].T[None]).reshape(len(rows), FILTERS, w, EMBEDDING)
            at = rows[sample[:, :, None], place[:, :, None] + np.arange(w)]
            np.add.at(grads["embedding"], at, into)
        return grads

    def train(self, rows: np.ndarray, truth: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for low in range(0, len(order), BATCH):
                pick = order[low : low + BATCH]
                step += 1
                for k, g in self.gradients(rows[pick], truth[pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def training_sample(docs: DataFrame, training: Column, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> list[tuple[bytes, str]]:
    """(window, language) of every window of at most max_docs labelled training texts a language, those of smallest hash.

    Counts of each language (the max_langs most frequent) say up to which hash
    texts are wanted, with a margin; the driver gets only those, each text once.
    """
    known = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, MARGIN * max_docs / r["count"])) for r in counts], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "text"), 11).cast("double") / F.lit(float(2**53))
    picked = known.withColumn("place", place).join(F.broadcast(shares), "lang").filter("place < share")
    rows = picked.groupBy("lang", "place", "text").agg(F.count("*").alias("n")).select("lang", "place", "text").collect()
    sample: list[tuple[bytes, str]] = []
    for lang in sorted({r["lang"] for r in rows}):
        own = sorted((r["place"], r["text"]) for r in rows if r["lang"] == lang)[:max_docs]
        texts = [t.encode() for _, t in own if LETTER.search(t)]
        sample += [(w.tobytes(), lang) for t in texts for w in windows(t)]
    return sample


def train(sample: list[tuple[bytes, str]]) -> ByteCnn | None:
    """A network over the sample's languages; None if there are none."""
    labels = sorted({lang for _, lang in sample})
    if not labels:
        return None
    net = ByteCnn(labels)
    rows = np.stack([np.frombuffer(cut, np.uint8) for cut, _ in sample])
    net.train(rows, np.array([labels.index(lang) for _, lang in sample]))
    return net


def predict(net: ByteCnn | None, texts: list[bytes], tables: tuple | None = None) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    tables = tables or net.tables()
    lettered = [i for i, t in enumerate(texts) if LETTER.search(t.decode("utf-8", "replace"))]
    cuts = [texts[i] for i in lettered]
    for low, high in byte_groups(cuts, BATCH_BYTES):
        rows = [windows(t) for t in cuts[low:high]]
        chances = net.probabilities(np.concatenate(rows), tables)
        ends = np.cumsum([len(r) for r in rows])
        for i, part in zip(lettered[low:high], np.split(chances, ends[:-1]), strict=True):
            mean = part.mean(axis=0)
            best = int(mean.argmax())
            langs[i], scores[i] = net.labels[best], float(min(mean[best], 1.0))
    return langs, scores


def _predictor(net: ByteCnn | None):
    cache: list[tuple] = []

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def udf(text: pa.Array) -> pa.Array:
        if net is not None and not cache:
            cache.append(net.tables())
        langs, scores = predict(net, text_bytes(text), *cache)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return udf


def identify(net: ByteCnn | None, text: str = "text") -> Column:
    """A struct (lang_pred, score) for each text, by a trained network."""
    return _predictor(net)(F.col(f"`{text}`"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket("doc_id", 4) == 2
    net = train(training_sample(docs, ~held_out))
    found = in_small_batches(docs).select("doc_id", held_out.alias("held_out"), identify(net).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
