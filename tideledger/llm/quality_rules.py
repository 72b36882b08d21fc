"""Quality rules as weak supervision.

Heuristic rules vote good (1), bad (0) or abstain (-1) on every document. A
latent-class model of the Dawid-Skene kind, fitted by expectation-maximisation on the counts
of vote patterns over the whole corpus, gives every rule its own rates of each
vote among good and among bad documents, and every document the posterior
probability of being good. That posterior replaces all-must-pass filtering;
only the two base limits (too few words, too much repetition) always reject.

Edge cases: a null text counts as empty, has no words and is rejected by the
base limits; repeated rows get equal verdicts; an empty table gives no rows;
columns of the input that clash with an added column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideledger.llm.common import MIX_B, batch_tokens, byte_groups, in_small_batches, packed, read_table, text_bytes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
BATCH_BYTES = 1 << 20

#: What the features measure, all as counts.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts", "n_echoes")
FEATURE_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in FEATURES])

ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes", "p_good", "kept")


def rolling(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each run of `window` consecutive token hashes."""
    n = max(0, len(hashes) - window + 1)
    rolled = hashes[:n].copy()
    for j in range(1, window):
        rolled *= MIX_B
        rolled += hashes[j : j + n]
    return rolled


def repeated_words(rolled: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice, from the hashes of a text's windows."""
    if len(rolled) < 2:
        return 0
    order = np.argsort(rolled)
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(len(rolled) + window, np.int64)
    found[order[1:][same]] = 1
    found[order[:-1][same]] = 1
    seen = np.cumsum(found)
    seen[window:] -= seen[:-window].copy()
    return int(np.count_nonzero(seen[:-1]))


def _line_counts(text: bytes) -> tuple[int, int]:
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    return len(lines), len(lines) - len(set(lines))


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)), np.int64)
    for low, high in byte_groups(texts, BATCH_BYTES):
        hashes, counts = batch_tokens(texts[low:high])
        rolled = rolling(hashes)
        at = 0
        for i, n in zip(range(low, high), counts.tolist(), strict=True):
            text = texts[i]
            raw = np.frombuffer(text, np.uint8)
            points = int(np.count_nonzero((raw & 0xC0) != 0x80))
            spaces = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
            lines, dup = _line_counts(text)
            letters = len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LOWER))
            own = hashes[at : at + n]
            echoes = int(np.count_nonzero(own[1:] == own[:-1]))
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            out[i] = (n, points - spaces, symbols, dup, repeated_words(rolled[at : at + max(0, n - WINDOW + 1)]), lines, *letters, text.count(b"!"), echoes)
            at += n
    return out


@F.arrow_udf(FEATURE_TYPE)
def _features_udf(text: pa.Array) -> pa.Array:
    table = features(text_bytes(text))
    return pa.StructArray.from_arrays([pa.array(table[:, j]) for j in range(len(FEATURES))], names=list(FEATURES))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rule_votes(f: str) -> dict[str, Column]:
    """The rules over the feature struct `f`; a rule without evidence abstains."""
    c = {name: F.col(f"{f}.{name}").cast("double") for name in FEATURES}
    words = F.greatest(c["n_words"], F.lit(1.0))
    cased = F.greatest(c["n_upper"] + c["n_lower"], F.lit(1.0))
    lines = F.greatest(c["n_lines"], F.lit(1.0))
    mean = c["word_chars"] / words
    some = c["n_words"] >= 5
    return {
        "length": _vote(c["n_words"] < 20, c["n_words"] >= 40),
        "word_length": _vote((mean < 2.5) | (mean > 12), some & mean.between(3.5, 9)),
        "symbols": _vote(c["n_symbols"] / words > 0.1, some & (c["n_symbols"] / words < 0.02)),
        "shouts": _vote(c["n_shouts"] / words > 0.2, some & (c["n_shouts"] / words < 0.02)),
        "capitals": _vote(some & (c["n_upper"] / cased > 0.5), some & (c["n_upper"] / cased < 0.15)),
        "lines": _vote((c["n_dup_lines"] >= 3) & (c["n_dup_lines"] / lines > 0.3), (c["n_lines"] >= 2) & (c["n_dup_lines"] == 0)),
        "repeats": _vote(c["n_repeat_words"] / words > 0.3, some & (c["n_repeat_words"] / words < 0.02)),
        "echoes": _vote(c["n_echoes"] / words > 0.2, some & (c["n_echoes"] / words < 0.05)),
    }


def fit_votes(patterns: list[tuple[str, int]], rounds: int = 200, most_false_alarms: float = 0.01, least_anchor: float = 0.5) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, from pattern counts.

    EM over one good class and one bad class for each rule, votes independent
    given the class, an abstention no evidence. Several bad classes are needed
    because kinds of junk exclude each other: with a single one, junk that only
    one rule knows would count as good for the other rules' votes. Estimates
    are free within two bounds that make the classes mean what they are named
    for, as an unsupervised model can't tell by itself: class k is the kind of
    junk that rule k was written for, so it votes bad on at least
    `least_anchor` of it; among good documents at most `most_false_alarms` of a
    rule's votes are bad. Without the first, classes trade places or melt into
    the good one; without the second a common kind of junk passes for good.
    """
    if not patterns:
        return {}
    order = sorted(patterns)
    votes = np.array([[int(v) for v in p.split(",")] for p, _ in order])
    weight = np.array([n for _, n in order], float)
    bad, good = (votes == 0).astype(float), (votes == 1).astype(float)
    n = votes.shape[1]
    floor = np.vstack([np.full((1, n), 1e-6), np.where(np.eye(n) > 0, least_anchor, 1e-6)])
    ceiling = np.vstack([np.full((1, n), most_false_alarms), np.full((n, n), 0.99)])
    alarms = np.vstack([np.full((1, n), most_false_alarms / 2), np.where(np.eye(n) > 0, 0.9, 0.1)])
    prior = np.array([0.85, *np.full(n, 0.15 / n)])
    posterior = np.full(len(order), prior[0])
    for _ in range(rounds):
        score = np.log(alarms) @ bad.T + np.log1p(-alarms) @ good.T + np.log(prior)[:, None]
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        mass = share * weight
        alarms = np.clip((mass @ bad + 0.01) / (mass @ (bad + good) + 0.1), floor, ceiling)
        prior = mass.sum(axis=1) + 0.01
        prior /= prior.sum()
        moved, posterior = np.abs(share[0] - posterior).max(), share[0]
        if moved < 1e-9:
            break
    return {p: float(g) for (p, _), g in zip(order, posterior, strict=True)}


def with_votes(rows: DataFrame, text: Column) -> DataFrame:
    """Add `f`, the features, and `marks`, the comma-joined votes."""
    rated = in_small_batches(rows).withColumn("f", _features_udf(text))
    return rated.withColumn("marks", F.concat_ws(",", *[v.cast("string") for v in rule_votes("f").values()]))


def score_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input with ADDED columns: base counts, votes, posterior and verdict.

    Two passes over the text: one counts vote patterns (at most 3 to the number
    of rules, whatever the corpus size), one applies the fitted posteriors.
    """
    column = F.col(f"`{text}`")
    counts = with_votes(docs.select(column.alias("t")), F.col("t")).groupBy("marks").count().collect()
    posterior = fit_votes([(r["marks"], r["count"]) for r in counts])
    table = docs.sparkSession.createDataFrame(list(posterior.items()), "marks string, p double")
    rated = with_votes(packed(docs), F.col(f"row.`{text}`")).join(F.broadcast(table), "marks", "left")
    f = {name: F.col(f"f.{name}") for name in FEATURES}
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
    verdict = F.when(failed, False).otherwise(F.coalesce(F.col("p"), F.lit(0.0)) >= threshold)
    added = [f[n].alias(n) for n in ADDED[:5]] + [failed.alias("base_failed"), F.col("marks").alias("votes"), F.col("p").alias("p_good"), verdict.alias("kept")]
    return rated.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *added)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules accept, with the input's columns."""
    rows = packed(docs).select(F.col(f"row.`{text}`").alias("t"), "row")
    return score_documents(rows, "t").filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs).select("doc_id", *ADDED)
