"""The jobs: sources, operators and sinks wired together, each a function that starts its streaming queries.

    python -m tideledger.jobs net_gmv --profile dev --folder conf

Topics are read from the message store, or from files under `message_dir` if
the settings name it; tables go to folders under `table_dir` unless a job is
given another sink. Every query has its own checkpoint, from which it goes on
after a stop, and a name, which must stay the same.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideledger.config import Settings, load_profile
from tideledger.functions.times import local_text
from tideledger.operators import marketing, orders, timeouts
from tideledger.sinks import adapters as sinks
from tideledger.sources import adapters as sources
from tideledger.streaming import processors

Write = Callable[[DataFrame, int], None]
Queries = list[StreamingQuery]


def _start(rows: DataFrame, name: str, write: Write, settings: Settings, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Start a query; every: its trigger's interval, or None to work off what is there and stop (not for jobs with timers of processing time, which wait for ever)."""
    writer = rows.writeStream.queryName(name).outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{settings.checkpoint_dir}/{name}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _messages(spark: SparkSession, topic: sources.Topic, settings: Settings) -> DataFrame:
    return sources.messages(spark, topic, settings.servers, settings.message_dir)


def _topic(spark: SparkSession, topic: sources.Topic, settings: Settings) -> Write:
    return sinks.topic_writer(spark, topic.name, settings.servers, settings.message_dir)


def _table(settings: Settings, name: str) -> str:
    return f"{settings.table_dir}/{name}"


def marketing_triggers(spark: SparkSession, settings: Settings, every: str | None = "1 second") -> Queries:
    """Carts and payments to coupon triggers, by rules and frequency control."""
    carts = marketing.parse_carts(_messages(spark, sources.CARTS, settings), settings.zone)
    pays = marketing.parse_pays(_messages(spark, sources.PAYMENTS, settings), settings.zone)
    triggers = processors.trigger_stream(processors.candidate_stream(carts, pays, settings), settings)
    return [_start(sinks.trigger_messages(triggers), "marketing_triggers", _topic(spark, sources.TRIGGERS, settings), settings, every)]


def trigger_loader(spark: SparkSession, settings: Settings, every: str | None = "10 seconds", write: Write | None = None) -> Queries:
    """Triggers from their topic to the serving table, one row for each trigger."""
    v = F.col("value")
    text = lambda name: F.get_json_object(v, f"$.{name}")
    rows = _messages(spark, sources.TRIGGERS, settings).select(
        "seq", text("triggerId").alias("trigger_id"), text("userId").try_cast("bigint").alias("user_id"), text("skuId").try_cast("bigint").alias("sku_id"), text("ruleCode").alias("rule_code"), text("triggerTimeMs").try_cast("bigint").alias("ts")
    )
    table = marketing.trigger_table(rows, settings.zone, carry=("seq",))
    return [_start(table, "trigger_loader", write or sinks.keyed_upsert(_table(settings, "coupon_trigger"), "trigger_id", "seq"), settings, every)]


def net_gmv(spark: SparkSession, settings: Settings, every: str | None = "5 seconds", write: Write | None = None) -> Queries:
    """Net daily GMV by original pay date, and the dead letters."""
    raw = _messages(spark, sources.NET_ORDERS, settings)
    totals = processors.total_stream(processors.delta_stream(raw, settings), settings)
    shaped = totals.select(F.col("biz_date").cast("string").alias("biz_date"), "gmv", local_text(F.col("update_ms"), settings.zone).alias("update_time"))
    _, dirty = orders.split_dirty(orders.validated(orders.parse_orders(raw)))
    letters = sinks.dead_letters(dirty, "net_gmv", "validation")
    return [
        _start(shaped, "net_gmv_totals", write or sinks.keyed_upsert(_table(settings, "daily_net_gmv"), "biz_date", "update_time"), settings, every),
        _start(letters, "net_gmv_dead_letters", sinks.append(_table(settings, "dead_letters")), settings, every),
    ]


def gross_gmv(spark: SparkSession, settings: Settings, every: str | None = "5 seconds", write: Write | None = None) -> Queries:
    """Gross daily GMV, a running sum of every paid row."""
    parsed = orders.parse_orders(_messages(spark, sources.GROSS_ORDERS, settings))
    totals = orders.gross_gmv(parsed.filter("error is null")).withColumn("update_time", local_text(F.unix_millis(F.current_timestamp()), settings.zone))
    letters = sinks.dead_letters(orders.short_pay_times(parsed).unionByName(parsed.filter("error is not null").select("seq", "value", "error")), "gross_gmv", "parse")
    return [
        _start(totals, "gross_gmv_totals", write or sinks.keyed_upsert(_table(settings, "daily_gross_gmv"), "biz_date", "update_time"), settings, every, "update"),
        _start(letters, "gross_gmv_dead_letters", sinks.append(_table(settings, "gross_dead_letters")), settings, every),
    ]


def today_gmv(spark: SparkSession, settings: Settings, every: str | None = "5 seconds", write: Write | None = None) -> Queries:
    """Today's GMV and number of paid orders, a snapshot every interval."""
    parsed = orders.parse_orders(_messages(spark, sources.TODAY_ORDERS, settings)).filter("error is null")
    snapshots = processors.today_stream(processors.correction_stream(parsed, settings), settings)
    at = local_text(F.col("stat_ms"), settings.zone)
    shaped = snapshots.select("dt", at.alias("stat_time"), "gmv", "paid_order_count", at.alias("update_time"))
    return [_start(shaped, "today_gmv", write or sinks.append(_table(settings, "today_gmv")), settings, every)]


def unpaid_timeouts(spark: SparkSession, settings: Settings, every: str | None = "1 second") -> Queries:
    """Orders without a payment by their deadline, to the timeout topic."""
    parsed = orders.parse_orders(_messages(spark, sources.UNPAID_ORDERS, settings)).filter("error is null")
    events = processors.timeout_stream(timeouts.order_events(parsed, settings.zone, settings.unpaid_timeout_ms), settings)
    return [_start(sinks.timeout_messages(events), "unpaid_timeouts", _topic(spark, sources.TIMEOUTS, settings), settings, every)]


def timeout_upserts(spark: SparkSession, settings: Settings, every: str | None = "1 second", write: Write | None = None) -> Queries:
    """Timeout events from their topic to a table with one row for each event."""
    events = timeouts.parse_timeout_events(_messages(spark, sources.TIMEOUTS, settings))
    return [_start(events, "timeout_upserts", write or sinks.keyed_upsert(_table(settings, "order_unpaid_timeout"), "timeout_event_id", "seq"), settings, every)]


def word_counts(spark: SparkSession, settings: Settings, every: str | None = "5 seconds", host: str = "localhost", port: int = 7777) -> Queries:
    """Words of a socket in windows of five seconds, printed."""
    counts = processors.word_stream(sources.socket_lines(spark, host, port))
    return [_start(counts, "word_counts", sinks.printed(), settings, every, "update")]


def mock_data(spark: SparkSession, settings: Settings, every: str | None = None, number: int = 1000, users: int = 100, days: int = 1) -> Queries:
    """Write order lifecycles, users and their activity to their topics, once."""
    made = sources.mock_orders(spark, number)
    made = made.withColumn("record_grain", F.lit(orders.GRAIN)).withColumn("currency_code", F.lit(orders.CURRENCY))
    for topic, rows, key in (
        (sources.NET_ORDERS.name, made.drop("seq"), "order_id"),
        ("user_active", sources.mock_activity(spark, users, days), "user_id"),
        ("dim_user", sources.mock_users(spark, users, days), "user_id"),
    ):
        sinks.topic_writer(spark, topic, settings.servers, settings.message_dir)(sinks.as_messages(rows, key), 0)
    return []


JOBS: dict[str, Callable[..., Queries]] = {f.__name__: f for f in (marketing_triggers, trigger_loader, net_gmv, gross_gmv, today_gmv, unpaid_timeouts, timeout_upserts, word_counts, mock_data)}


def main() -> None:
    from tideledger.session import build_session

    asked = argparse.ArgumentParser(description=__doc__)
    asked.add_argument("job", choices=sorted(JOBS))
    asked.add_argument("--profile", required=True)
    asked.add_argument("--folder", default="conf")
    asked.add_argument("--overlay")
    given = asked.parse_args()
    settings = load_profile(given.profile, given.folder, given.overlay)
    if not settings.checkpoint_dir and given.job != "mock_data":
        raise SystemExit("checkpoint_dir must name a folder that all machines share")
    spark = build_session(f"tideledger {given.job}")
    print(f"{given.job}: {settings}")
    for query in JOBS[given.job](spark, settings):
        query.awaitTermination()


if __name__ == "__main__":
    main()
