"""Unpaid-order timeouts, keyed upserts, and the word count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.functions.text import is_blank, joined, json_long, json_text, words
from tideledger.functions.times import local_millis, local_text

# fixed values: the rule's code, and statuses that end the wait for a payment
RULE_CODE = "UNPAID_ORDER_10MIN"
SETTLED = ("PAID", "FINISHED", "REFUNDED", "CANCELLED")


#: A timeout event's fields, in the order of its message.
TIMEOUT_FIELDS = ("timeout_event_id", "order_id", "user_id", "sku_id", "pay_amount", "order_status", "rule_code", "create_time", "timeout_time", "dt", "create_time_ms", "timeout_time_ms")


def is_settled() -> Column:
    """A pay time, or a status that ends the wait."""
    return ~is_blank(F.col("pay_time")) | F.coalesce(F.col("order_status").isin(*SETTLED), F.lit(False))


def order_events(parsed: DataFrame, zone: str, timeout_ms: int = 60_000) -> DataFrame:
    """Rows with an order id and a creation time; event time is the pay time, or else the creation time.

    timeout_time and dt: when the wait ends, and the day it began, in the zone.
    """
    known = parsed.filter(~is_blank(F.col("order_id")) & ~is_blank(F.col("create_time")))
    created, paid = local_millis(F.col("create_time"), zone), F.coalesce(local_millis(F.col("pay_time"), zone), F.lit(0))
    timed = known.withColumn("create_ms", created).withColumn("pay_ms", paid).filter("create_ms is not null")
    timed = timed.withColumn("timeout_time", local_text(F.col("create_ms") + timeout_ms, zone)).withColumn("dt", F.substring("create_time", 1, 10))
    return timed.withColumn("event_ms", F.when(F.col("pay_ms") > 0, F.col("pay_ms")).otherwise(F.col("create_ms")))


def _fired(events: DataFrame, fires: Column, timeout_ms: int) -> DataFrame:
    due = F.col("create_ms") + timeout_ms
    name = joined(F.col("order_id"), F.lit(RULE_CODE))
    return events.filter(fires & ~is_settled()).select(name.alias("timeout_event_id"), "order_id", "seq", "order_status", F.lit(RULE_CODE).alias("rule_code"), F.col("create_ms").alias("create_time_ms"), due.alias("timeout_time_ms"))


def unpaid_timeouts(events: DataFrame, timeout_ms: int) -> DataFrame:
    """By intent: an unpaid row fires unless the order's next row came by its deadline."""
    later = F.lead("event_ms").over(W.partitionBy("order_id").orderBy("seq"))
    marked = events.withColumn("_next", later)
    return _fired(marked, F.col("_next").isNull() | (F.col("_next") > F.col("create_ms") + timeout_ms), timeout_ms)


def unpaid_timeouts_exact(events: DataFrame, timeout_ms: int, delay_ms: int) -> DataFrame:
    """As a stream with a watermark after every event decides; it needs a global order, so it is for tests."""
    before = W.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    one = W.partitionBy("order_id").orderBy("seq")
    seen = events.withColumn("_most", F.max("event_ms").over(before)).withColumn("_next", F.lead("seq").over(one)).withColumn("_then", F.lead("_most").over(one))
    return _fired(seen, F.col("_next").isNull() | (F.col("_then") - delay_ms - 1 >= F.col("create_ms") + timeout_ms), timeout_ms)


def timeout_events(events: DataFrame, timeout_ms: int) -> DataFrame:
    """The timeout events with all their fields, by intent."""
    fired = unpaid_timeouts(events, timeout_ms)
    more = [F.col(c).cast("string").alias(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("user_id", "sku_id", "pay_amount", "create_time", "timeout_time", "dt")]
    return fired.join(events.select("order_id", "seq", *more), ["order_id", "seq"]).select(*TIMEOUT_FIELDS, "seq")


def parse_timeout_events(raw: DataFrame) -> DataFrame:
    """Timeout events from their messages (camelCase fields); rows without event or order id are dropped, absent times are 0."""
    v = F.col("value")
    columns = []
    for name in TIMEOUT_FIELDS:
        head, *rest = name.split("_")
        camel = "$." + head + "".join(part.capitalize() for part in rest)
        columns.append((json_long(v, camel) if name.endswith("_ms") else json_text(v, camel)).alias(name))
    parsed = raw.select("seq", *columns)
    return parsed.filter(~is_blank(F.col("timeout_event_id")) & ~is_blank(F.col("order_id")))


def latest(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Upsert semantics: the last row of each key."""
    names = [F.col(c) for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")


def word_counts(lines: DataFrame, time: str, text: str, width: str) -> DataFrame:
    """Words between single spaces, counted in tumbling windows."""
    each = lines.select(F.col(time).alias("t"), F.explode(words(F.col(text))).alias("word"))
    return each.groupBy(F.window("t", width).alias("w"), "word").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "word", "n")
