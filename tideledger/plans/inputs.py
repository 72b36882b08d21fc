"""Order snapshots, carts and payments derived from the star-schema tables, as JSON messages.

Each derivation is one SELECT that both engines can run; only adding seconds
and whole division are spelt differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.sources.adapters import as_json

#: Field by field; money is text of whole cents with two decimals.
SNAPSHOTS = """
SELECT k * 10 + v AS seq, CAST(k AS {string}) AS order_id,
  CASE WHEN v = 1 THEN 'UNPAID' WHEN v = 2 AND st = 'O' THEN 'CANCELLED' WHEN v = 2 THEN ' paid ' WHEN v = 3 AND k % 10 = 0 THEN 'REFUNDED'
       WHEN v = 3 THEN 'PARTIALLY_REFUNDED' WHEN v = 4 THEN 'PAID' WHEN k % 2 = 0 THEN 'PAID' ELSE 'LOST' END AS order_status,
  CASE WHEN v = 5 AND k % 2 = 0 THEN NULL ELSE cents END AS pay_cents,
  CASE WHEN v = 3 AND k % 10 = 0 THEN cents WHEN v = 3 THEN {back} ELSE 0 END AS refund_cents,
  CAST({created} AS {string}) AS create_time,
  CASE WHEN v = 1 OR (v = 2 AND st = 'O') THEN '' ELSE CAST({paid} AS {string}) END AS pay_time,
  CAST({updated} AS {string}) AS update_time
FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS st, CAST(o_orderdate AS {naive}) AS d, v
      FROM orders CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) versions
      WHERE v = 1 OR (v = 2 AND (o_orderstatus <> 'O' OR o_orderkey % 5 = 0)) OR (v = 3 AND o_orderstatus = 'P')
         OR (v = 4 AND o_orderkey % 7 = 0) OR (v = 5 AND o_orderkey % 11 = 0)) versions
"""

CLICKS = """
SELECT event_id AS seq, event_id, user_id, {k} % 3 AS sku_id, {k} % 7 AS spu_id, event_type, CAST({second} AS {string}) AS event_time, {k} AS k
FROM events WHERE event_type IN ('click', 'purchase', 'signup')
"""


def _fill(sql: str, spark: bool) -> str:
    add = (lambda t, n: f"timestampadd(SECOND, CAST({n} AS INT), {t})") if spark else (lambda t, n: f"({t} + to_seconds({n}))")
    half = "(cents * (k % 9 + 1)) " + ("div" if spark else "//") + " 10"
    return sql.format(
        string="STRING" if spark else "VARCHAR",
        naive="TIMESTAMP_NTZ" if spark else "TIMESTAMP",
        back=half,
        created=add("d", "k % 86400"),
        paid=add("d", "k % 86400 + 30 + CASE WHEN v = 3 AND k % 17 = 0 THEN 86400 ELSE 0 END"),
        updated=add("d", "k % 86400 + 60 * CASE WHEN v = 4 THEN 2 ELSE v END"),
        k="CAST(get_json_object(props, '$.k') AS BIGINT)" if spark else "CAST(props->>'$.k' AS BIGINT)",
        second="date_trunc('SECOND', ts)" if spark else "date_trunc('second', ts)",
    )


SNAPSHOTS_SQL = _fill(SNAPSHOTS, False)
CLICKS_SQL = _fill(CLICKS, False)


#: The columns of each table that the derivations use, the key first.
COLUMNS = {"orders": ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"), "events": ("user_id", "event_id", "event_type", "ts", "props")}


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal the rows out by a key if the table has fewer splits than there are cores; a large table stays as it is read."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def _run(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """The derivation over the columns it needs of one table."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*COLUMNS[table])
    if table == "events":
        rows = rows.filter(F.col("event_type").isin("click", "purchase", "signup"))
    return spark.sql(_fill(sql, True).replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spread(rows, COLUMNS[table][0])})


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): order snapshots as JSON, one in 13 orders' first message cut short."""
    rows = _run(spark, sf_dir, "orders", SNAPSHOTS)
    money = lambda c: (F.col(c) / 100).cast("decimal(18,2)").cast("string")
    shaped = rows.withColumn("pay_amount", money("pay_cents")).withColumn("refund_amount", money("refund_cents")).drop("pay_cents", "refund_cents")
    messages = as_json(shaped)
    broken = (F.col("seq") % 10 == 1) & (F.floor(F.col("seq") / 10) % 13 == 0)
    return messages.withColumn("value", F.when(broken, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value")))


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "events", CLICKS)


def cart_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of carts: clicks; every 9th a deletion, every 10th repeats the id of the one before."""
    rows = _clicks(spark, sf_dir).filter("event_type = 'click'")
    shown = F.when(F.col("seq") % 10 == 0, F.lit("dup")).otherwise(F.col("event_id").cast("string"))
    after = F.struct(shown.alias("event_id"), "user_id", "sku_id", "spu_id", F.when(F.col("k") % 4 > 0, F.col("k") % 4).alias("quantity"), "event_time")
    op = F.when(F.col("seq") % 9 == 0, "d").when(F.col("seq") % 2 == 0, "c").otherwise("u")
    return rows.select("seq", F.to_json(F.struct(op.alias("op"), after.alias("after"))).alias("value"))


def pay_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of orders: purchases paid or finished, signups unpaid."""
    rows = _clicks(spark, sf_dir).filter("event_type <> 'click'")
    status = F.when(F.col("event_type") == "signup", "UNPAID").when(F.col("seq") % 2 == 0, "PAID").otherwise("FINISHED")
    after = F.struct(F.col("event_id").alias("order_id"), "user_id", "sku_id", status.alias("order_status"), F.col("event_time").alias("pay_time"))
    return rows.select("seq", F.to_json(F.struct(F.lit("c").alias("op"), after.alias("after"))).alias("value"))
