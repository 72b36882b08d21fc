"""A corpus pipeline: quality rules, line dedup, near-dedup, source mixing, piece encoding.

Each stage works on all that the one before it kept. All but the last return
the columns of `documents`; the last returns the encoded documents.

Edge cases: a null, empty or short text goes in the first stage, which rejects
texts of under 20 words; rows with a null doc_id stay documents; of rows with
equal id and text one passes near-dedup; copies that source mixing makes of a
document are encoded alike; other columns than COLUMNS are not carried; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideledger.llm import line_templates, mixing, pieces, quality_rules, simhash
from tideledger.llm.common import discard, read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weakly supervised quality rules reject."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of templates that recur across documents, but for their first document."""
    return line_templates.drop_recurring(docs.select(*COLUMNS)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights of their sources, in a global shuffle."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode as pieces with seeded merge-dropout."""
    return pieces.encode_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mix),
    ("piece_encoding", encode),
]

#: The first stage fits its rules by expectation-maximisation, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again but for the last; a stage's table goes once the next is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
