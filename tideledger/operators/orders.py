"""Net paid GMV: order snapshots to signed daily deltas, with a dead-letter output.

Input rows have `seq`, the arrival order, and `value`, the JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideledger.functions.text import computed_once, is_blank, is_white, trimmed
from tideledger.functions.times import local_datetime, next_boundary

# fixed values: statuses of the order contract
ZERO_STATUSES = ("UNPAID", "CANCELLED", "CANCELED", "CLOSED")
PAID_STATUSES = ("PAID", "PART_REFUNDED", "PARTIALLY_REFUNDED", "REFUNDED")
PART_STATUSES = ("PART_REFUNDED", "PARTIALLY_REFUNDED")

FIELDS = ("order_id", "user_id", "sku_id", "order_status", "pay_amount", "refund_amount", "create_time", "pay_time", "update_time", "order_version", "event_id", "record_grain", "currency_code", "dt")
SCHEMA = ", ".join(f"{name} string" for name in FIELDS) + ", _corrupt string"
AMOUNTS = ("pay_amount", "refund_amount")
AMOUNT = "decimal(38,10)"

#: Arrival numbers of a day that one task sums in order.
SPAN = 1 << 20


def parse_orders(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Snapshots with typed amounts, and `error`, why the text cannot be one (null: it can).

    strict: the first text that cannot be one fails the job instead.
    """
    j = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # a generator keeps the optimizer from parsing the text again for every use of a field
    rows = raw.select("seq", "value", F.inline(F.array(j)))
    nested = F.lit(False)
    for name in FIELDS:
        nested = nested | F.coalesce(F.col(name).rlike(r"^\s*[\{\[]"), F.lit(False))
    odd = F.lit(False)
    for name in AMOUNTS:
        odd = odd | (~is_blank(F.col(name)) & F.col(name).try_cast(AMOUNT).isNull())
    error = (
        F.when(is_blank(F.col("value")) | F.col("_corrupt").isNotNull(), "malformed JSON")
        .when(nested, "nested value in a field")
        .when(odd, "amount is not a number")
        .when(is_white(F.col("order_id")), "order_id is missing")
        .when(is_white(F.col("order_status")), "order_status is missing")
    )
    typed = rows.withColumn("error", error)
    for name in AMOUNTS:
        typed = typed.withColumn(name, F.col(name).try_cast(AMOUNT))
    if strict:
        reason = F.concat(F.lit("message "), F.col("seq").cast("string"), F.lit(": "), F.col("error"))
        typed = typed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(reason)))
    return computed_once(typed.drop("_corrupt"))


def status_of(c: Column) -> Column:
    return F.upper(trimmed(c))


def validation_error() -> Column:
    """The first rule that a snapshot breaks, or null."""
    status, pay, refund = status_of(F.col("order_status")), F.col("pay_amount"), F.col("refund_amount")
    paid = status.isin(*PAID_STATUSES)
    return F.coalesce(
        F.when(is_blank(F.col("order_id")), "order_id is missing"),
        F.when(is_blank(F.col("order_status")), "order_status is missing"),
        F.when(is_blank(F.col("update_time")), "update_time is missing"),
        F.when(~status.isin(*ZERO_STATUSES, *PAID_STATUSES), "unknown order_status"),
        F.when(paid & pay.isNull(), "pay_amount must not be null"),
        F.when(paid & refund.isNull(), "refund_amount must not be null"),
        F.when(paid & (pay <= 0), "pay_amount must be positive"),
        F.when(paid & (refund < 0), "refund_amount must not be negative"),
        F.when(paid & (refund > pay), "refund_amount exceeds pay_amount"),
        F.when(paid & is_blank(F.col("pay_time")), "pay_time is missing"),
        F.when((status == "PAID") & (refund != 0), "a paid order has no refund"),
        F.when(status.isin(*PART_STATUSES) & ((refund <= 0) | (refund >= pay)), "a partial refund lies between nothing and everything"),
        F.when((status == "REFUNDED") & (refund != pay), "a full refund equals the payment"),
        F.when(~is_blank(F.col("update_time")) & local_datetime(F.col("update_time")).isNull(), "update_time is malformed"),
        F.when(~is_blank(F.col("pay_time")) & local_datetime(F.col("pay_time")).isNull(), "pay_time is malformed"),
    )


# fixed values: what the contract allows besides
GRAIN, CURRENCY = "ORDER", "CNY"


def contract_error() -> Column:
    """The first rule of the strict contract that a snapshot breaks, or null: grain, currency, a version, one event id."""
    return F.coalesce(
        F.when(F.coalesce(trimmed(F.col("record_grain")), F.lit("")) != GRAIN, "record_grain must be ORDER"),
        F.when(F.coalesce(trimmed(F.col("currency_code")), F.lit("")) != CURRENCY, "currency_code must be CNY"),
        F.when(F.col("order_version").try_cast("bigint").isNull(), "order_version is not a number"),
        F.when(is_blank(F.col("event_id")), "event_id is missing"),
    )


def validated(parsed: DataFrame, contract: bool = False) -> DataFrame:
    """Parsed rows with `error`, why they are not valid; contract: also by the strict contract, whose version is order_version."""
    more = [contract_error()] if contract else []
    return computed_once(parsed.withColumn("error", F.coalesce("error", validation_error(), *more)))


def split_dirty(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, dead letters): nothing is lost without a reason."""
    dirty = checked.filter("error is not null").select("seq", "value", "error")
    return checked.filter("error is null").drop("error"), dirty


def contribution(deduct_refunds: bool = True) -> Column:
    """What a valid snapshot adds to its day."""
    status = status_of(F.col("order_status"))
    net = F.greatest(F.col("pay_amount") - F.col("refund_amount"), F.lit(0).cast(AMOUNT)) if deduct_refunds else F.col("pay_amount")
    return F.when(status.isin(*ZERO_STATUSES), F.lit(0).cast(AMOUNT)).when(status.isin(*PAID_STATUSES), net.cast(AMOUNT))


def accepted(clean: DataFrame, version_column: str = "update_time") -> DataFrame:
    """Snapshots newer than every valid one of the same order before them."""
    version = local_datetime(F.col(version_column)) if version_column == "update_time" else F.col(version_column).try_cast("bigint")
    before = W.partitionBy("order_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    known = clean.withColumn("version", version).withColumn("_latest", F.max("version").over(before))
    return known.filter(F.col("_latest").isNull() | (F.col("version") > F.col("_latest"))).drop("_latest")


def unversioned_after_versioned(clean: DataFrame, version_column: str = "update_time") -> DataFrame:
    """Dead letters (seq, value, error): snapshots without a version after one of their order with one, which the gate holds back."""
    version = local_datetime(F.col(version_column)) if version_column == "update_time" else F.col(version_column).try_cast("bigint")
    before = W.partitionBy("order_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    known = clean.withColumn("_version", version).withColumn("_latest", F.max("_version").over(before))
    return known.filter("_version is null and _latest is not null").select("seq", "value", F.lit("no version after a versioned snapshot").alias("error"))


def contributions(clean: DataFrame, deduct_refunds: bool = True, version_column: str = "update_time") -> DataFrame:
    """Accepted snapshots with their contribution and business date, carried on when the pay time is absent."""
    upto = W.partitionBy("order_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    dated = accepted(clean, version_column).withColumn("contribution", contribution(deduct_refunds))
    return dated.withColumn("biz_date", F.last(F.to_date(local_datetime(F.col("pay_time"))), ignorenulls=True).over(upto))


def deltas(contributed: DataFrame) -> DataFrame:
    """(order_id, seq, part, biz_date, delta): a change of amount, or revocation of the old date and addition to the new."""
    one = W.partitionBy("order_id").orderBy("seq")
    old = F.coalesce(F.lag("contribution").over(one), F.lit(0).cast(AMOUNT))
    held = contributed.withColumn("_old", old).withColumn("_old_date", F.lag("biz_date").over(one))
    item = lambda part, day, amount: F.struct(F.lit(part).alias("part"), day.alias("biz_date"), amount.cast("decimal(38,10)").alias("delta"))
    new, day = F.col("contribution"), F.col("biz_date")
    same = F.array(item(0, day, new - F.col("_old")))
    moved = F.array(item(0, F.col("_old_date"), -F.col("_old")), item(1, day, new))
    items = F.when(day.eqNullSafe(F.col("_old_date")), same).otherwise(moved)
    wanted = F.filter(items, lambda x: x["biz_date"].isNotNull() & (x["delta"] != 0))
    return held.select("order_id", "seq", F.inline(wanted))


def daily_totals(changes: DataFrame) -> DataFrame:
    """(biz_date, gmv); partial sums before the shuffle keep a busy day from landing in one task."""
    return changes.groupBy("biz_date").agg(F.sum("delta").cast("decimal(18,2)").alias("gmv"))


def net_gmv(raw: DataFrame, deduct_refunds: bool = True) -> DataFrame:
    clean, _ = split_dirty(validated(parse_orders(raw)))
    return daily_totals(deltas(contributions(clean, deduct_refunds)))


def paid_rows(parsed: DataFrame) -> DataFrame:
    """Gross GMV's filter: identified, paid, with a time and an amount of 0 or more."""
    present = F.col("order_id").isNotNull() & F.col("pay_time").isNotNull() & F.col("pay_amount").isNotNull()
    return parsed.filter(present & (F.col("pay_amount") >= 0) & (F.upper("order_status") == "PAID") & (F.length("pay_time") >= 10))


def short_pay_times(parsed: DataFrame) -> DataFrame:
    """Dead letters (seq, value, error): rows that gross GMV would count if their pay time had a whole date."""
    present = F.col("error").isNull() & F.col("order_id").isNotNull() & (F.col("pay_amount") >= 0) & (F.upper("order_status") == "PAID")
    return parsed.filter(present & (F.length("pay_time") < 10)).select("seq", "value", F.lit("pay_time is too short").alias("error"))


def gross_gmv(parsed: DataFrame) -> DataFrame:
    """Sum of every paid row, resent ones included, by the date in the pay time's text."""
    return paid_rows(parsed).groupBy(F.substring("pay_time", 1, 10).alias("biz_date")).agg(F.sum("pay_amount").cast("decimal(18,2)").alias("gmv"))


def gross_gmv_changelog(parsed: DataFrame) -> DataFrame:
    """The running total after every paid row, a day in spans of arrival numbers (see `running`)."""
    rows = paid_rows(parsed).select("seq", F.substring("pay_time", 1, 10).alias("biz_date"), F.col("pay_amount").alias("_v"))
    return running(rows, "biz_date", ("seq",), {"_v": AMOUNT}).select("seq", "biz_date", F.col("_v_sum").cast("decimal(18,2)").alias("gmv"))


def running(rows: DataFrame, day: str, order: tuple[str, ...], values: dict[str, str], span: int = SPAN) -> DataFrame:
    """The rows with `<v>_sum` and `<v>_least`, each value's running sum and the least running sum so far.

    A day's rows are summed in spans of `span` arrival numbers (the first of
    `order`), so that a busy day is many tasks; what the spans before add is a
    running sum over the few spans of a day, joined back.
    """
    cut = rows.withColumn("_span", F.floor(F.col(order[0]) / span))
    within = W.partitionBy(day, "_span").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = cut
    for v, kind in values.items():
        local = local.withColumn(f"{v}_sum", F.sum(v).over(within).cast(kind))
    for v, kind in values.items():
        local = local.withColumn(f"{v}_least", F.min(f"{v}_sum").over(within))
    ends = local.groupBy(day, "_span").agg(*[F.sum(v).cast(kind).alias(f"{v}_total") for v, kind in values.items()], *[F.min(f"{v}_sum").alias(f"{v}_low") for v in values])
    before = W.partitionBy(day).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    for v, kind in values.items():
        ends = ends.withColumn(f"{v}_off", F.coalesce(F.sum(f"{v}_total").over(before), F.lit(0)).cast(kind))
    for v in values:
        ends = ends.withColumn(f"{v}_past", F.min(F.col(f"{v}_off") + F.col(f"{v}_low")).over(before))
    offsets = ends.select(F.col(day).alias("_day"), F.col("_span").alias("_of"), *[c for v in values for c in (f"{v}_off", f"{v}_past")])
    joined = local.join(offsets, F.col(day).eqNullSafe(F.col("_day")) & (F.col("_span") == F.col("_of")))
    for v, kind in values.items():
        joined = joined.withColumn(f"{v}_sum", (F.col(f"{v}_sum") + F.col(f"{v}_off")).cast(kind)).withColumn(f"{v}_least", F.least(F.col(f"{v}_past"), F.col(f"{v}_least") + F.col(f"{v}_off")).cast(kind))
    return joined.select(*rows.columns, *[c for v in values for c in (f"{v}_sum", f"{v}_least")])


def day_share() -> tuple[Column, Column]:
    """What an order gives to its day, and whether its status and amount let it."""
    net = F.round(F.coalesce("pay_amount", F.lit(0)) - F.coalesce("refund_amount", F.lit(0)), 2).cast("decimal(18,2)")
    return net, F.coalesce(F.col("order_status").isin("PAID", "FINISHED") & (net > 0), F.lit(False))


def day_contribution(parsed: DataFrame, as_of: Column) -> DataFrame:
    """Same-day GMV: (seq, order_id, dt, gmv); dt and gmv are null unless the order counts on the day `as_of`."""
    net, positive = day_share()
    counts = F.coalesce(positive & (F.to_date(local_datetime(F.col("pay_time"))) == as_of), F.lit(False))
    return parsed.filter(~is_blank(F.col("order_id"))).select("seq", "order_id", F.when(counts, as_of).alias("dt"), F.when(counts, net).alias("gmv"))


def corrections(rows: DataFrame) -> DataFrame:
    """(seq, part, order_id, dt, gmv, orders): reversal of an order's last contribution, then the new one, where it changed."""
    one = W.partitionBy("order_id").orderBy("seq")
    held = rows.withColumn("_dt", F.lag("dt").over(one)).withColumn("_gmv", F.lag("gmv").over(one))
    changed = held.filter(~(F.col("dt").eqNullSafe(F.col("_dt")) & F.col("gmv").eqNullSafe(F.col("_gmv"))))
    item = lambda part, day, amount, n: F.struct(F.lit(part).alias("part"), day.alias("dt"), amount.cast("decimal(18,2)").alias("gmv"), F.lit(n).cast("bigint").alias("orders"))
    both = F.array(item(0, F.col("_dt"), -F.col("_gmv"), -1), item(1, F.col("dt"), F.col("gmv"), 1))
    return changed.select("seq", "order_id", F.inline(F.filter(both, lambda x: x["dt"].isNotNull())))


def clamped_running(changes: DataFrame) -> DataFrame:
    """Running total and order count of each day, each held at 0 or more after every step.

    A total held at zero equals the free sum less its least value so far, if that is negative.
    """
    money, number = "decimal(18,2)", "bigint"
    free = running(changes.select("seq", "part", "dt", F.col("gmv").alias("_g"), F.col("orders").alias("_n")), "dt", ("seq", "part"), {"_g": money, "_n": number})
    held = lambda c, kind: (F.col(f"{c}_sum") - F.least(F.lit(0).cast(kind), F.col(f"{c}_least"))).cast(kind)
    return free.select("seq", "part", "dt", held("_g", money).alias("gmv"), held("_n", number).alias("paid_order_count"))


def snapshots(changes: DataFrame, time_ms: Column, every_ms: int) -> DataFrame:
    """The last value of each interval that saw a change: (biz_date, stat_ms, gmv)."""
    stat = next_boundary(time_ms, every_ms)
    upto = W.partitionBy("biz_date").orderBy("stat_ms")
    steps = changes.withColumn("stat_ms", stat).groupBy("biz_date", "stat_ms").agg(F.sum("delta").alias("d"))
    return steps.select("biz_date", "stat_ms", F.sum("d").over(upto).cast("decimal(18,2)").alias("gmv"))
