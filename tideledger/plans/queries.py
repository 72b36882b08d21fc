"""The queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.config import DAY_MS, Settings
from tideledger.operators import marketing, orders, timeouts
from tideledger.plans import inputs
from tideledger.sources.adapters import daily_activity

#: Events are sparse, so the windows are wider than in production.
WIDE = Settings(zone="Asia/Shanghai", repeat_window_ms=3 * DAY_MS, abandon_after_ms=DAY_MS)
AS_OF = "1998-03-01"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SNAP = f"""
snap AS ({inputs.SNAPSHOTS_SQL}),
parsed AS (
  SELECT seq, order_id, order_status, upper(trim(order_status)) AS status, pay_cents, refund_cents, create_time, pay_time, update_time,
         seq % 10 = 1 AND (seq // 10) % 13 = 0 AS broken FROM snap),
checked AS (
  SELECT *, CASE WHEN broken THEN 'malformed JSON'
    WHEN status NOT IN ('UNPAID', 'CANCELLED', 'CANCELED', 'CLOSED', 'PAID', 'PART_REFUNDED', 'PARTIALLY_REFUNDED', 'REFUNDED') THEN 'unknown order_status'
    WHEN status IN ('UNPAID', 'CANCELLED') THEN NULL
    WHEN pay_cents IS NULL THEN 'pay_amount must not be null'
    WHEN pay_cents <= 0 THEN 'pay_amount must be positive'
    WHEN refund_cents > pay_cents THEN 'refund_amount exceeds pay_amount'
    WHEN status = 'PAID' AND refund_cents <> 0 THEN 'a paid order has no refund'
    WHEN status = 'PARTIALLY_REFUNDED' AND (refund_cents <= 0 OR refund_cents >= pay_cents) THEN 'a partial refund lies between nothing and everything'
    WHEN status = 'REFUNDED' AND refund_cents <> pay_cents THEN 'a full refund equals the payment' END AS error FROM parsed),
clean AS (SELECT * FROM checked WHERE error IS NULL),
gated AS (SELECT *, max(update_time) OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM clean),
accepted AS (SELECT * FROM gated WHERE latest IS NULL OR update_time > latest),
contributed AS (
  SELECT *, CASE WHEN status IN ('UNPAID', 'CANCELLED') THEN 0 ELSE greatest(pay_cents - refund_cents, 0) END AS cents,
         last_value(CASE WHEN pay_time <> '' THEN CAST(pay_time[1:10] AS DATE) END IGNORE NULLS)
           OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS biz_date FROM accepted),
held AS (
  SELECT *, coalesce(lag(cents) OVER w, 0) AS old_cents, lag(biz_date) OVER w AS old_date FROM contributed WINDOW w AS (PARTITION BY order_id ORDER BY seq)),
deltas AS (
  SELECT order_id, seq, 0 AS part, biz_date, cents - old_cents AS c FROM held WHERE biz_date IS NOT DISTINCT FROM old_date AND biz_date IS NOT NULL AND cents <> old_cents
  UNION ALL SELECT order_id, seq, 0, old_date, -old_cents FROM held WHERE biz_date IS DISTINCT FROM old_date AND old_date IS NOT NULL AND old_cents <> 0
  UNION ALL SELECT order_id, seq, 1, biz_date, cents FROM held WHERE biz_date IS DISTINCT FROM old_date AND biz_date IS NOT NULL AND cents <> 0),
gross AS (SELECT seq, pay_time[1:10] AS biz_date, pay_cents FROM parsed WHERE NOT broken AND upper(order_status) = 'PAID' AND pay_cents >= 0 AND length(pay_time) >= 10),
today AS (
  SELECT seq, order_id, CASE WHEN counts THEN DATE '{AS_OF}' END AS dt, CASE WHEN counts THEN pay_cents - refund_cents END AS cents
  FROM (SELECT *, coalesce(order_status IN ('PAID', 'FINISHED') AND pay_time[1:10] = '{AS_OF}' AND pay_cents - refund_cents > 0, FALSE) AS counts FROM parsed WHERE NOT broken)),
moved AS (SELECT *, lag(dt) OVER w AS old_dt, lag(cents) OVER w AS old_cents FROM today WINDOW w AS (PARTITION BY order_id ORDER BY seq)),
corrected AS (
  SELECT seq, 0 AS part, order_id, old_dt AS dt, -old_cents AS cents, -1 AS n FROM moved WHERE old_dt IS NOT NULL AND (dt IS DISTINCT FROM old_dt OR cents IS DISTINCT FROM old_cents)
  UNION ALL SELECT seq, 1, order_id, dt, cents, 1 FROM moved WHERE dt IS NOT NULL AND (dt IS DISTINCT FROM old_dt OR cents IS DISTINCT FROM old_cents)),
events_of AS (
  SELECT *, epoch_ms(CAST(create_time AS TIMESTAMP)) - 28800000 AS create_ms,
         CASE WHEN pay_time <> '' THEN epoch_ms(CAST(pay_time AS TIMESTAMP)) - 28800000 ELSE epoch_ms(CAST(create_time AS TIMESTAMP)) - 28800000 END AS event_ms,
         pay_time <> '' OR order_status IN ('PAID', 'FINISHED', 'REFUNDED', 'CANCELLED') AS settled FROM parsed WHERE NOT broken),
waiting AS (SELECT *, lead(event_ms) OVER (PARTITION BY order_id ORDER BY seq) AS next_ms FROM events_of),
fired AS (SELECT order_id || '_UNPAID_ORDER_10MIN' AS timeout_event_id, order_id, seq, order_status, 'UNPAID_ORDER_10MIN' AS rule_code, create_ms AS create_time_ms, create_ms + 60000 AS timeout_time_ms
          FROM waiting WHERE NOT settled AND (next_ms IS NULL OR next_ms > create_ms + 60000))
"""

_CLICKS = f"""
clicks AS ({inputs.CLICKS_SQL}),
carts AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN 'dup' ELSE event_id::VARCHAR END AS event_id, user_id, sku_id, spu_id,
                 CASE WHEN k % 4 > 0 THEN k % 4 ELSE 1 END::INTEGER AS quantity, epoch_ms(CAST(event_time AS TIMESTAMP)) - 28800000 AS event_time
          FROM clicks WHERE event_type = 'click' AND seq % 9 <> 0),
pays AS (SELECT seq, 'pay_' || event_id AS event_id, event_id AS order_id, user_id, sku_id, epoch_ms(CAST(event_time AS TIMESTAMP)) - 28800000 AS event_time FROM clicks WHERE event_type = 'purchase'),
both_kinds AS (SELECT seq, event_id, user_id, sku_id, event_time, 0 AS is_pay FROM carts UNION ALL SELECT seq, event_id, user_id, sku_id, event_time, 1 FROM pays),
firsts AS (SELECT * FROM both_kinds QUALIFY row_number() OVER (PARTITION BY user_id, sku_id, event_id ORDER BY seq) = 1),
tagged AS (SELECT *, sum(is_pay) OVER w AS segment, lead(event_time) OVER w AS next_time FROM firsts WINDOW w AS (PARTITION BY user_id, sku_id ORDER BY event_time, seq)),
counted AS (SELECT *, sum(1 - is_pay) OVER (PARTITION BY user_id, sku_id, segment ORDER BY event_time RANGE BETWEEN {WIDE.repeat_window_ms} PRECEDING AND CURRENT ROW) AS n FROM tagged),
candidates AS (
  SELECT user_id, sku_id, event_time, seq, 'REPEAT_CART_1H' AS rule_code, 0::BIGINT AS trigger_time, event_id AS source_event_id FROM counted WHERE is_pay = 0 AND n >= {WIDE.repeat_count}
  UNION ALL SELECT user_id, sku_id, event_time, seq, 'ABANDON_CART_30MIN', event_time + {WIDE.abandon_after_ms}, NULL FROM counted
  WHERE is_pay = 0 AND (next_time IS NULL OR next_time >= event_time + {WIDE.abandon_after_ms})),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq, rule_code) AS i,
         CAST(make_timestamp_ms(ts + 28800000) AS DATE) AS day
  FROM (SELECT user_id, sku_id, seq, rule_code, CASE WHEN trigger_time > 0 THEN trigger_time ELSE event_time END AS ts FROM candidates)),
RECURSIVE_FOLD
"""

_FOLD = f"""
fold AS (
  SELECT user_id, 0::BIGINT AS i, [{{'ts': 0::BIGINT, 'rule': '', 'sku': 0::BIGINT, 'day': DATE '1900-01-01'}}][1:0] AS pushed, [0::BIGINT][1:0] AS risk, FALSE AS sent, NULL::BIGINT AS sku_id, NULL::VARCHAR AS rule_code, NULL::BIGINT AS ts, NULL::DATE AS day
  FROM (SELECT DISTINCT user_id FROM ordered)
  UNION ALL
  SELECT user_id, i, CASE WHEN ok THEN list_append(pushed, {{'ts': ts, 'rule': rule_code, 'sku': sku_id, 'day': day}}) ELSE pushed END, risk, ok, sku_id, rule_code, ts, day FROM (
    SELECT *, NOT (len(list_filter(pushed, lambda p: p.rule = rule_code AND ts - p.ts < {WIDE.same_rule_ms})) > 0
      OR len(list_filter(pushed, lambda p: p.rule = rule_code AND p.sku = sku_id AND ts - p.ts < {WIDE.same_sku_ms})) > 0
      OR len(list_filter(pushed, lambda p: p.day = day)) >= {WIDE.daily_pushes}
      OR len(list_filter(risk, lambda r: ts - r <= {WIDE.risk_window_ms})) >= {WIDE.risk_count}) AS ok FROM (
      SELECT f.user_id, o.i, f.pushed, o.sku_id, o.rule_code, o.ts, o.day,
             CASE WHEN o.rule_code = 'ABANDON_CART_30MIN' THEN list_append(list_filter(f.risk, lambda r: o.ts - r <= {WIDE.risk_window_ms}), o.ts) ELSE f.risk END AS risk
      FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.i = f.i + 1)))
"""


def _snap(select: str) -> str:
    return f"WITH {_SNAP} {select}"


def _cart(select: str, fold: bool = False) -> str:
    body = _CLICKS.replace("RECURSIVE_FOLD", _FOLD) if fold else _CLICKS.replace(",\nRECURSIVE_FOLD", "")
    return f"WITH {'RECURSIVE ' if fold else ''}{body} {select}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.parse_orders(inputs.order_messages(spark, sf_dir))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.validated(_parsed(spark, sf_dir))


def _contributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.contributions(orders.split_dirty(_checked(spark, sf_dir))[0])


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).filter("error is null")


def _money(c: str, name: str) -> Column:
    return (F.col(c) * 100).cast("bigint").alias(name)


@query(_snap("SELECT seq, order_id, order_status, pay_cents, refund_cents, pay_time, update_time FROM parsed WHERE NOT broken"))
def order_json_parse(spark, sf_dir):
    return _sound(spark, sf_dir).select("seq", "order_id", "order_status", _money("pay_amount", "pay_cents"), _money("refund_amount", "refund_cents"), "pay_time", "update_time")


@query(_snap("SELECT error, count(*) AS n FROM checked WHERE error IS NOT NULL GROUP BY error"))
def order_dirty_reasons(spark, sf_dir):
    return orders.split_dirty(_checked(spark, sf_dir))[1].groupBy("error").agg(F.count("*").alias("n"))


@query(_snap("SELECT seq, 'json' AS kind FROM parsed WHERE broken UNION ALL SELECT seq, 'business' FROM checked WHERE error IS NOT NULL AND NOT broken"))
def dirty_union(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    unread = parsed.filter("error is not null").select("seq", F.lit("json").alias("kind"))
    unfit = orders.split_dirty(orders.validated(parsed.filter("error is null")))[1].select("seq", F.lit("business").alias("kind"))
    return unread.unionByName(unfit)


@query(_snap("SELECT order_id, seq, update_time FROM accepted"))
def order_version_gate(spark, sf_dir):
    return orders.accepted(orders.split_dirty(_checked(spark, sf_dir))[0]).select("order_id", "seq", "update_time")


@query(_snap("SELECT order_id, seq, cents, biz_date FROM contributed"))
def order_contribution(spark, sf_dir):
    return _contributed(spark, sf_dir).select("order_id", "seq", _money("contribution", "cents"), "biz_date")


@query(_snap("SELECT order_id, seq, part, biz_date, c AS delta_cents FROM deltas"))
def gmv_deltas(spark, sf_dir):
    return orders.deltas(_contributed(spark, sf_dir)).select("order_id", "seq", "part", "biz_date", _money("delta", "delta_cents"))


@query(_snap("SELECT biz_date, sum(c)::BIGINT AS gmv_cents FROM deltas GROUP BY biz_date"))
def net_gmv_by_pay_date(spark, sf_dir):
    return orders.net_gmv(inputs.order_messages(spark, sf_dir)).select("biz_date", _money("gmv", "gmv_cents"))


@query(_snap("SELECT biz_date, sum(pay_cents)::BIGINT AS gmv_cents FROM gross GROUP BY biz_date"))
def gross_gmv_by_day(spark, sf_dir):
    return orders.gross_gmv(_sound(spark, sf_dir)).select("biz_date", _money("gmv", "gmv_cents"))


@query(_snap("SELECT seq, biz_date, (sum(pay_cents) OVER (PARTITION BY biz_date ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS gmv_cents FROM gross"))
def gross_gmv_running(spark, sf_dir):
    return orders.gross_gmv_changelog(_sound(spark, sf_dir)).select("seq", "biz_date", _money("gmv", "gmv_cents"))


@query(_snap("SELECT seq, part, order_id, dt, cents::BIGINT AS gmv_cents, n::BIGINT AS orders FROM corrected"))
def today_gmv_correction(spark, sf_dir):
    rows = orders.day_contribution(_sound(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return orders.corrections(rows).select("seq", "part", "order_id", "dt", _money("gmv", "gmv_cents"), "orders")


@query(
    _snap("""SELECT seq, part, dt, (s - least(0, min(s) OVER w))::BIGINT AS gmv_cents, (m - least(0, min(m) OVER w))::BIGINT AS paid_order_count
    FROM (SELECT *, sum(cents) OVER v AS s, sum(n) OVER v AS m FROM corrected WINDOW v AS (PARTITION BY dt ORDER BY seq, part ROWS UNBOUNDED PRECEDING))
    WINDOW w AS (PARTITION BY dt ORDER BY seq, part ROWS UNBOUNDED PRECEDING)""")
)
def today_gmv_clamped(spark, sf_dir):
    rows = orders.day_contribution(_sound(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return orders.clamped_running(orders.corrections(rows)).select("seq", "part", "dt", _money("gmv", "gmv_cents"), "paid_order_count")


@query(
    _snap("""SELECT biz_date, stat_ms, (sum(c) OVER (PARTITION BY biz_date ORDER BY stat_ms))::BIGINT AS gmv_cents
    FROM (SELECT biz_date, (seq // 5000 + 1) * 5000 AS stat_ms, sum(c) AS c FROM deltas GROUP BY ALL)""")
)
def gmv_snapshot_grid(spark, sf_dir):
    changes = orders.deltas(_contributed(spark, sf_dir))
    return orders.snapshots(changes, F.col("seq"), WIDE.output_every_ms).select("biz_date", "stat_ms", _money("gmv", "gmv_cents"))


@query(_cart("SELECT seq, event_id, user_id, sku_id, spu_id, quantity, event_time FROM carts"))
def parse_cart_cdc(spark, sf_dir):
    return marketing.parse_carts(inputs.cart_messages(spark, sf_dir), WIDE.zone)


@query(_cart("SELECT seq, event_id, order_id, user_id, sku_id, event_time FROM pays"))
def parse_pay_cdc(spark, sf_dir):
    return marketing.parse_pays(inputs.pay_messages(spark, sf_dir), WIDE.zone)


@query(_cart("SELECT seq, event_id, user_id, sku_id FROM carts QUALIFY row_number() OVER (PARTITION BY user_id, sku_id, event_id ORDER BY seq) = 1"))
def event_dedup(spark, sf_dir):
    return marketing.first_events(parse_cart_cdc(spark, sf_dir)).select("seq", "event_id", "user_id", "sku_id")


@query(_cart("SELECT user_id, sku_id, event_time, seq, rule_code, trigger_time, source_event_id FROM candidates"))
def coupon_candidates(spark, sf_dir):
    return marketing.candidates(parse_cart_cdc(spark, sf_dir), parse_pay_cdc(spark, sf_dir), WIDE)


@query(_cart("SELECT user_id, sku_id, seq, source_event_id FROM candidates WHERE rule_code = 'REPEAT_CART_1H'"))
def repeat_cart(spark, sf_dir):
    return coupon_candidates(spark, sf_dir).filter(F.col("rule_code") == marketing.REPEAT).select("user_id", "sku_id", "seq", "source_event_id")


@query(_cart("SELECT user_id, sku_id, seq, trigger_time FROM candidates WHERE rule_code = 'ABANDON_CART_30MIN'"))
def abandon_cart(spark, sf_dir):
    return coupon_candidates(spark, sf_dir).filter(F.col("rule_code") == marketing.ABANDON).select("user_id", "sku_id", "seq", "trigger_time")


def _timed(spark, sf_dir):
    at = F.when(F.col("trigger_time") > 0, F.col("trigger_time")).otherwise(F.col("event_time"))
    return coupon_candidates(spark, sf_dir).withColumn("ts", at)


_ID = "user_id || '_' || sku_id || '_' || rule_code || '_' || year(day) || 'W' || weekofyear(day)"


@query(_cart(f"SELECT user_id, sku_id, rule_code, ts, {_ID} AS trigger_id FROM fold WHERE sent", fold=True))
def frequency_control(spark, sf_dir):
    return marketing.frequency_control(_timed(spark, sf_dir), WIDE)


@query(_cart(f"SELECT {_ID} AS trigger_id, user_id, sku_id, rule_code, ts AS trigger_time_ms, make_timestamp_ms(ts) AS trigger_time, day AS dt FROM fold WHERE sent", fold=True))
def trigger_sql_projection(spark, sf_dir):
    return marketing.trigger_table(frequency_control(spark, sf_dir), WIDE.zone)


@query(_cart(f"SELECT DISTINCT {_ID} AS trigger_id FROM ordered"))
def weekly_trigger_id(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    day = marketing.business_day(F.col("ts"), WIDE.zone)
    return rows.select(marketing.trigger_id(F.col("user_id"), F.col("sku_id"), F.col("rule_code"), day).alias("trigger_id")).distinct()


def _timeouts(spark, sf_dir):
    return timeouts.unpaid_timeouts(timeouts.order_events(_sound(spark, sf_dir), WIDE.zone), WIDE.unpaid_timeout_ms)


@query(_snap("SELECT * FROM fired"))
def unpaid_timeout(spark, sf_dir):
    return _timeouts(spark, sf_dir)


@query(_snap("SELECT * FROM fired QUALIFY row_number() OVER (PARTITION BY timeout_event_id ORDER BY seq DESC) = 1"))
def timeout_upsert_latest(spark, sf_dir):
    return timeouts.latest(_timeouts(spark, sf_dir), "timeout_event_id")


@query("""SELECT time_bucket(INTERVAL '5 seconds', TIMESTAMP '2024-01-01' + to_seconds(doc_id)) AS window_start, word, count(*) AS n
    FROM (SELECT doc_id, unnest(CASE WHEN text = '' THEN [''] WHEN trim(text, ' ') = '' THEN [] ELSE string_split(regexp_replace(text, ' +$', ''), ' ') END) AS word FROM documents) GROUP BY ALL""")
def tumbling_word_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = F.timestamp_add("SECOND", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return timeouts.word_counts(docs.select(at.alias("t"), "text"), "t", "text", "5 seconds")


@query("SELECT user_id, CAST(ts AS DATE) AS dt, min(ts) AS active_time FROM events GROUP BY ALL")
def user_active_daily(spark, sf_dir):
    return daily_activity(spark.read.parquet(f"{sf_dir}/events.parquet"))
