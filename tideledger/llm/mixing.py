"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the wanted corpus over its
share of the given one. Every document draws its number of copies from the
Poisson distribution with that mean, by inverting the distribution at a uniform
number taken from a keyed hash of its id, is exploded into that many copies,
and the copies are shuffled over the whole corpus by another keyed hash.

Rates need one count per source. They are broadcast while there are at most
`max_broadcast` sources; beyond that documents join them on (source, salt), so
that no source, however large, lands in one task. Copies spread over the
partitions by the shuffle key itself.

Edge cases: a null source is a source of its own; rows with equal doc_id (or a
null one) draw alike; a source wanted with weight zero yields no copies; an
empty table gives no rows; input columns that clash with an added column are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.llm.common import id_text, packed, read_table, shuffle_partitions

SEED = 42
EXPONENT = 0.7
EPOCHS = 1.0
MAX_BROADCAST = 10_000
SALTS = 64
ADDED = ("copy", "rate", "shuffle_key")


def keyed_hash(bits: int, *parts: Column) -> Column:
    """The first bits (a multiple of 4, at most 60) of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def target_rates(docs: DataFrame, source: str = "source", exponent: float = EXPONENT, epochs: float = EPOCHS, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate): mean copies of a document.

    Sources are wanted in proportion to `weights`, or else to their number of
    documents to the power of `exponent`; `epochs` is the size of the result
    over the size of the input.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.count("*").cast("double").alias("n"))
    wanted = F.pow("n", F.lit(exponent))
    if weights is not None:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        wanted = F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0)).cast("double")
    weighed = counts.withColumn("w", wanted)
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return weighed.crossJoin(F.broadcast(total)).select("_source", F.coalesce(F.try_divide(F.col("w") * F.col("all_n") * F.lit(epochs), F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the tail is below any uniform number's grain.

    Terms are built in logarithms, so that a large mean does not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(a: Column, k: Column) -> Column:
        log_p = a["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = a["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(a["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["steps"])).otherwise(F.array(F.lit(2.0)))


def replicate(docs: DataFrame, rates: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = SEED, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Copies of the documents with ADDED columns: copy from 1, the source's rate, the shuffle key."""
    stepped = rates.select("_source", "rate", poisson_steps(F.col("rate")).alias("_steps"))
    names = [c for c in docs.columns if c not in ADDED]
    given, key_of = packed(docs.select(*[F.col(f"`{c}`") for c in names])), f"row.`{doc_id}`"
    same = F.col(f"row.`{source}`").eqNullSafe(F.col("_source"))
    if len(rates.select("_source").limit(max_broadcast + 1).collect()) <= max_broadcast:
        joined = given.join(F.broadcast(stepped), same)
    else:
        salt = F.pmod(F.xxhash64(F.col(key_of), F.hash("row")), F.lit(SALTS)).cast("int")
        salted = stepped.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = given.withColumn("_salt", salt).join(salted, same & (F.col("_salt") == F.col("_salt_of"))).drop("_salt", "_salt_of")
    name = id_text(key_of)
    uniform = (keyed_hash(52, F.lit(str(seed)), F.lit("copies"), name).cast("double") + 0.5) / F.lit(float(2**52))
    drawn = joined.withColumn("_u", uniform).withColumn("_n", F.size(F.filter("_steps", lambda c: c <= F.col("_u"))))
    copies = drawn.filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = keyed_hash(60, F.lit(str(seed)), F.lit("order"), name, F.col("copy").cast("string"))
    return copies.select(*[F.col(f"row.`{c}`") for c in names], "copy", "rate", key.alias("shuffle_key"))


def shuffle_globally(copies: DataFrame, partitions: int | None = None) -> DataFrame:
    """Put rows in the order of their shuffle key: range partitions of the key's whole span, sorted within each."""
    n = partitions or shuffle_partitions(copies.sparkSession)
    place = F.floor(F.col("shuffle_key").cast("double") / F.lit(float(2**60)) * n).cast("int")
    return copies.repartitionById(n, F.least(place, F.lit(n - 1))).sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", exponent: float = EXPONENT, epochs: float = EPOCHS, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    rates = target_rates(docs, source, exponent, epochs, weights)
    return shuffle_globally(replicate(docs, rates, doc_id, source, seed))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mix(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return mixed.withColumn("rate", F.round("rate", 6))


#: The copies of a table `docs` as (its columns, copy, rate, shuffle_key).
REPLICATE_SQL = """
counts AS (SELECT source, count(*)::DOUBLE AS n FROM docs GROUP BY source),
rates AS (SELECT source, pow(n, 0.7) * sum(n) OVER () / (sum(pow(n, 0.7)) OVER () * n) AS rate FROM counts),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
          FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k)),
steps AS (SELECT source, rate, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT d.doc_id, count(*) AS n
          FROM (SELECT DISTINCT doc_id, source FROM docs) d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
          WHERE s.c <= (('0x' || substr(md5('42:copies:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0
          GROUP BY d.doc_id),
copies AS (SELECT d.*, c.copy, r.rate,
                  ('0x' || substr(md5('42:order:' || coalesce(d.doc_id::VARCHAR, '') || ':' || c.copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
           FROM docs d JOIN drawn n ON d.doc_id IS NOT DISTINCT FROM n.doc_id JOIN rates r ON d.source IS NOT DISTINCT FROM r.source,
                LATERAL (SELECT unnest(range(1, n.n + 1))::INTEGER AS copy) c)
"""

ORACLE = f"""
WITH docs AS (SELECT doc_id, text, lang, source, n_chars FROM documents), {REPLICATE_SQL}
SELECT doc_id, text, lang, source, n_chars, copy, round(rate, 6) AS rate, shuffle_key FROM copies
"""
