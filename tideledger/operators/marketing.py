"""Marketing triggers: cart and payment change events to coupon candidates, and their frequency control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.config import Settings
from tideledger.functions.text import CONTROLS, is_blank, joined, json_long, json_text
from tideledger.functions.times import business_day, local_millis, week_name

# fixed values: rule codes and what a trigger says about them
ABANDON = "ABANDON_CART_30MIN"
REPEAT = "REPEAT_CART_1H"
REASONS = {ABANDON: "cart left unpaid for 30 minutes", REPEAT: "same item in the cart 3 times within 1 hour"}


def _living(raw: DataFrame) -> DataFrame:
    after = json_text(F.col("value"), "$.after")
    return raw.filter(after.isNotNull() & ~F.coalesce(json_text(F.col("value"), "$.op") == "d", F.lit(False)))


def parse_carts(raw: DataFrame, zone: str) -> DataFrame:
    """Cart additions from change events: creations, updates and snapshot reads alike, deletions dropped."""
    v = F.col("value")
    quantity = F.coalesce(json_text(v, "$.after.quantity").try_cast("int"), F.lit(1))
    return _living(raw).select(
        "seq",
        json_text(v, "$.after.event_id").alias("event_id"),
        json_long(v, "$.after.user_id").alias("user_id"),
        json_long(v, "$.after.sku_id").alias("sku_id"),
        json_long(v, "$.after.spu_id").alias("spu_id"),
        quantity.alias("quantity"),
        local_millis(json_text(v, "$.after.event_time"), zone).alias("event_time"),
    )


def parse_pays(raw: DataFrame, zone: str) -> DataFrame:
    """Payments from order change events: status PAID or FINISHED with a pay time."""
    v = F.col("value")
    paid = json_text(v, "$.after.order_status").isin("PAID", "FINISHED") & json_text(v, "$.after.pay_time").isNotNull()
    return _living(raw).filter(paid).select(
        "seq",
        F.concat(F.lit("pay_"), json_long(v, "$.after.order_id").cast("string")).alias("event_id"),
        json_long(v, "$.after.order_id").alias("order_id"),
        json_long(v, "$.after.user_id").alias("user_id"),
        json_long(v, "$.after.sku_id").alias("sku_id"),
        local_millis(json_text(v, "$.after.pay_time"), zone).alias("event_time"),
    )


def first_events(events: DataFrame, keys: tuple[str, ...] = ("user_id", "sku_id")) -> DataFrame:
    """Drop repeats of an event id within a key; blank ids are never repeats."""
    row = F.row_number().over(W.partitionBy(*keys, "event_id").orderBy("seq"))
    return events.withColumn("_nr", row).filter((F.col("_nr") == 1) | is_blank(F.col("event_id"))).drop("_nr")


def candidates(carts: DataFrame, pays: DataFrame, settings: Settings) -> DataFrame:
    """Abandoned and repeated carts by user and item; a payment cancels the wait and empties the window."""
    shape = lambda df, pay: df.select("seq", "event_id", "user_id", "sku_id", "event_time", F.lit(pay).alias("is_pay"))
    both = first_events(shape(carts, 0).unionByName(shape(pays, 1)))
    one = W.partitionBy("user_id", "sku_id").orderBy("event_time", "seq")
    tagged = both.withColumn("segment", F.sum("is_pay").over(one)).withColumn("_next", F.lead("event_time").over(one))
    recent = W.partitionBy("user_id", "sku_id", "segment").orderBy("event_time").rangeBetween(-settings.repeat_window_ms, 0)
    counted = tagged.withColumn("_n", F.sum(1 - F.col("is_pay")).over(recent)).filter("is_pay = 0")
    due = F.col("event_time") + settings.abandon_after_ms
    item = lambda rule, at, source: F.struct(F.lit(rule).alias("rule_code"), at.alias("trigger_time"), source.alias("source_event_id"))
    repeat = F.when(F.col("_n") >= settings.repeat_count, item(REPEAT, F.lit(0).cast("bigint"), F.col("event_id")))
    abandon = F.when(F.col("_next").isNull() | (F.col("_next") >= due), item(ABANDON, due, F.lit(None).cast("string")))
    return counted.select("user_id", "sku_id", "event_time", "seq", F.inline(F.array_compact(F.array(repeat, abandon))))


def trigger_id(user: Column, sku: Column, rule: Column, day: Column) -> Column:
    return joined(user, sku, rule, week_name(day))


def frequency_control(found: DataFrame, settings: Settings) -> DataFrame:
    """Candidates that may be pushed: (user_id, sku_id, rule_code, ts, trigger_id).

    Input: user_id, sku_id, rule_code, ts (epoch ms), seq. Whether one is pushed
    depends on those pushed before, so each user's candidates are folded in
    order. Of what was pushed only the last time of each rule and of each rule
    and item within their windows, and the pushes of the day, can matter, so
    older ones are dropped from the state, which does not grow with the history.
    """
    day = business_day(F.col("ts"), settings.zone)
    row = F.struct("ts", "seq", "rule_code", "sku_id", day.alias("day"))
    kind = "array<struct<ts:bigint,seq:bigint,rule_code:string,sku_id:bigint,day:date>>"
    start = F.struct(F.array().cast(kind).alias("pushed"), F.array().cast("array<bigint>").alias("risk"), F.array().cast(kind).alias("sent"))

    def step(a: Column, x: Column) -> Column:
        risky = x["rule_code"] == ABANDON
        lately = F.filter(a["risk"], lambda t: x["ts"] - t <= settings.risk_window_ms)
        risk = F.when(risky, F.concat(lately, F.array(x["ts"]))).otherwise(a["risk"])
        of_risk = F.size(F.filter(risk, lambda t: x["ts"] - t <= settings.risk_window_ms))
        blocked = (
            F.exists(a["pushed"], lambda p: (p["rule_code"] == x["rule_code"]) & (x["ts"] - p["ts"] < settings.same_rule_ms))
            | F.exists(a["pushed"], lambda p: (p["rule_code"] == x["rule_code"]) & (p["sku_id"] == x["sku_id"]) & (x["ts"] - p["ts"] < settings.same_sku_ms))
            | (F.size(F.filter(a["pushed"], lambda p: p["day"] == x["day"])) >= settings.daily_pushes)
            | (of_risk >= settings.risk_count)
        )
        longest = max(settings.same_rule_ms, settings.same_sku_ms)
        lasting = F.filter(a["pushed"], lambda p: (x["ts"] - p["ts"] < longest) | (p["day"] == x["day"]))
        sent = F.when(blocked, F.array().cast(kind)).otherwise(F.array(x))
        return F.struct(F.concat(lasting, sent).alias("pushed"), risk.alias("risk"), F.concat(a["sent"], sent).alias("sent"))

    folded = found.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    pushed = folded.select("user_id", F.inline(F.aggregate("rows", start, step, lambda a: a["sent"])))
    return pushed.select("user_id", "sku_id", "rule_code", "ts", trigger_id(F.col("user_id"), F.col("sku_id"), F.col("rule_code"), F.col("day")).alias("trigger_id"))


def trigger_table(triggers: DataFrame, zone: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The serving table's columns, after those to carry: dates and times derived from epoch milliseconds."""
    return triggers.select(*carry, "trigger_id", "user_id", "sku_id", "rule_code", F.col("ts").alias("trigger_time_ms"), F.timestamp_add("MILLISECOND", F.col("ts"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("trigger_time"), business_day(F.col("ts"), zone).alias("dt"))
