"""Sources: message streams, sockets, files, and a deterministic generator of order lifecycles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STARTS = {"earliest": "earliest", "latest": "latest", "committed": "earliest"}


def starting_offsets(name: str) -> str:
    """Kafka's start of a first run; later runs go on from the checkpoint, which stands for committed offsets."""
    key = (name or "").strip().lower()
    if key not in STARTS:
        raise ValueError(f"unknown starting offsets: {name}")
    return STARTS[key]


def kafka_options(servers: str, topic: str, start: str = "committed") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting_offsets(start), "failOnDataLoss": "true"}


@dataclass(frozen=True)
class Topic:
    """A job's source: topic, consumer group and first start."""

    name: str
    group: str
    start: str = "latest"


# fixed values: the jobs' topics and groups
CARTS = Topic("ods_cart_add_event", "marketing-cart-group")
PAYMENTS = Topic("ods_order_item", "marketing-order-group")
UNPAID_ORDERS = Topic("dwd_order_detail", "unpaid-order-timeout-group")
TIMEOUTS = Topic("dws_order_unpaid_timeout", "unpaid-order-timeout-pg-group")
GROSS_ORDERS = Topic("dwd_order_detail", "realtime-gmv-group", "committed")
TODAY_ORDERS = Topic("ods_order_detail", "today-gmv-group", "earliest")
NET_ORDERS = Topic("ods_order_detail", "daily-gmv-group", "committed")
TRIGGERS = Topic("coupon_trigger_topic", "coupon-trigger-group")
TOPICS = {"carts": CARTS, "payments": PAYMENTS, "unpaid_orders": UNPAID_ORDERS, "timeouts": TIMEOUTS, "gross_orders": GROSS_ORDERS, "today_orders": TODAY_ORDERS, "net_orders": NET_ORDERS, "triggers": TRIGGERS}

MESSAGE = "seq long, key string, value string"


def arrival(time_ms: Column, offset: Column) -> Column:
    """An arrival number that compares across partitions: by the message's time, then by its offset in the partition."""
    return time_ms * F.lit(1 << 20) + F.pmod(offset, F.lit(1 << 20))


def kafka_values(spark: SparkSession, servers: str, topic: Topic) -> DataFrame:
    """A topic's messages (seq, key, value); needs the message store's package on the class path."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topic.name, topic.start)).option("groupIdPrefix", topic.group).load()
    return stream.select(arrival(F.unix_millis("timestamp"), F.col("offset")).alias("seq"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def message_files(spark: SparkSession, message_dir: str, topic: Topic, streaming: bool = True) -> DataFrame:
    """A topic kept as files of JSON lines (seq, key, value), one folder for each topic."""
    reader = spark.readStream.option("maxFilesPerTrigger", 64) if streaming else spark.read
    return reader.schema(MESSAGE).option("recursiveFileLookup", "true").json(f"{message_dir}/{topic.name}")


def messages(spark: SparkSession, topic: Topic, servers: str, message_dir: str = "") -> DataFrame:
    """A topic as a stream of (seq, key, value): of files if message_dir names any, or else of the message store."""
    return message_files(spark, message_dir, topic) if message_dir else kafka_values(spark, servers, topic)


def json_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Files of one JSON text a line, without arrival numbers."""
    return (spark.readStream if streaming else spark.read).format("text").load(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines (value, timestamp) of a socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", "true").load()


def mock_orders(spark: SparkSession, orders: int, start: str = "2031-02-03 08:00:00", seed: int = 42) -> DataFrame:
    """Order lifecycles as snapshots: unpaid; then 10 in 100 cancelled, 80 paid; of those some refunded.

    Rates and amounts are fixed values of the generator. Every choice is a hash of seed and order number, so that any part of the
    table is the same whenever and wherever it is made.
    """
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n))
    fate, refund = draw("fate", 100), draw("refund", 100)
    last = F.when(fate < 10, 1).when(fate < 20, 2).otherwise(F.when(refund < 25, F.when((refund < 15) & (draw("rest", 100) < 20), 4).otherwise(3)).otherwise(2))
    base = spark.range(orders).withColumn("version", F.explode(F.sequence(F.lit(1), last)))
    v = F.col("version")
    status = (
        F.when(v == 1, "UNPAID")
        .when(fate < 20, "CANCELLED")
        .when(v == 2, "PAID")
        .when((v == 3) & (refund < 15), "PARTIALLY_REFUNDED")
        .otherwise("REFUNDED")
    )
    cents = draw("amount", 48_001) + 2_000
    back = F.when(status == "REFUNDED", cents).when(status == "PARTIALLY_REFUNDED", F.floor(cents * (draw("part", 80) + 10) / 100)).otherwise(0)
    created = F.lit(start).cast("timestamp_ntz")
    at = lambda n: F.timestamp_add("SECOND", (draw("start", 7_080) + n * (draw("step", 30) + 1)).cast("int"), created).cast("string")
    money = lambda c: (c / 100).cast("decimal(18,2)")
    paid = (fate >= 20) & (v >= 2)
    return base.select(
        (F.col("id") * 8 + v).alias("seq"),
        F.concat(F.lit("order-"), F.col("id").cast("string")).alias("order_id"),
        status.alias("order_status"),
        money(cents).alias("pay_amount"),
        money(back).alias("refund_amount"),
        at(F.lit(0)).alias("create_time"),
        F.when(paid, at(F.lit(1))).otherwise("").alias("pay_time"),
        at(v - 1).alias("update_time"),
        v.alias("order_version"),
        F.concat(F.lit("order-"), F.col("id").cast("string"), F.lit("-v"), v.cast("string")).alias("event_id"),
    )


def as_json(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c != "seq"]
    return rows.select("seq", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def daily_activity(events: DataFrame) -> DataFrame:
    """One row for each user and day: (user_id, dt, active_time), the first time seen."""
    return events.groupBy("user_id", F.to_date("ts").alias("dt")).agg(F.min("ts").alias("active_time"))


def mock_users(spark: SparkSession, users: int, days: int, start: str = "2031-02-03 00:00:00", seed: int = 42) -> DataFrame:
    """(user_id, register_time, dt): every user's row of the daily snapshot; register times lie in the year before."""
    each = spark.range(users).crossJoin(F.broadcast(spark.range(days).select(F.col("id").cast("int").alias("day"))))
    began = F.lit(start).cast("timestamp_ntz")
    back = F.pmod(F.xxhash64(F.lit(seed), F.lit("register"), F.col("id")), F.lit(365 * 86_400)).cast("int")
    return each.select(F.concat(F.lit("user-"), F.col("id").cast("string")).alias("user_id"), F.timestamp_add("SECOND", -back, began).cast("string").alias("register_time"), F.date_add(F.to_date(began), F.col("day")).cast("string").alias("dt"))


def mock_activity(spark: SparkSession, users: int, days: int, start: str = "2031-02-03 00:00:00", seed: int = 42) -> DataFrame:
    """(user_id, active_time, dt): one moment of every user and day."""
    second = F.pmod(F.xxhash64(F.lit(seed), F.lit("active"), F.col("user_id"), F.col("dt")), F.lit(86_400)).cast("int")
    rows = mock_users(spark, users, days, start, seed)
    return rows.select("user_id", F.timestamp_add("SECOND", second, F.col("dt").cast("timestamp_ntz")).cast("string").alias("active_time"), "dt")
