"""Refund, version, date-correction and dirty-data cases of the net GMV contract."""

import json
import random
import time
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideledger.config import Settings, load_settings, read_properties, required
from tideledger.functions.text import is_white, words
from tideledger.functions.times import local_text
from tideledger.operators import orders
from tideledger.operators.timeouts import order_events, unpaid_timeouts, unpaid_timeouts_exact
from tideledger.sinks.adapters import keyed_upsert, read_upserted, upsert_statement
from tideledger.sources.adapters import as_json, mock_orders, starting_offsets
from tideledger.streaming.processors import DELTA, delta_stream, timeout_stream

DAY1, DAY2 = "2031-05-20", "2031-05-21"


def snapshot(order, pay, refund, status, pay_time, update_time):
    return json.dumps({"order_id": order, "pay_amount": pay, "refund_amount": refund, "order_status": status, "pay_time": pay_time, "update_time": update_time, "create_time": f"{DAY1} 09:30:00"})


#: Several orders interleaved; after the tilde what each message must give, worked out by the rules.
MESSAGES = [
    snapshot("p7", "0", "0", "UNPAID", "", f"{DAY1} 10:00:00"),  # ~ nothing: no date, no amount
    snapshot("q2", "250.50", "0", "PAID", f"{DAY1} 10:05:00", f"{DAY1} 10:05:10"),  # ~ +250.50
    snapshot("p7", "75.25", "0", "PAID", f"{DAY1} 10:06:00", f"{DAY1} 10:06:05"),  # ~ +75.25
    snapshot("q2", "250.50", "50.10", "PARTIALLY_REFUNDED", f"{DAY1} 10:05:00", f"{DAY1} 11:00:00"),  # ~ -50.10
    snapshot("p7", "0", "0", "CANCELLED", "", f"{DAY1} 11:30:00"),  # ~ -75.25, on the day it was paid
    snapshot("q2", "250.50", "70.10", "PART_REFUNDED", f"{DAY1} 10:05:00", f"{DAY1} 10:59:59"),  # ~ nothing: older
    snapshot("r9", "12.00", "0.00", "PAID", f"{DAY1} 23:58:00", f"{DAY2} 00:00:30"),  # ~ +12
    snapshot("r9", "12.00", "0.00", "PAID", f"{DAY2} 00:00:10", f"{DAY2} 00:01:00"),  # ~ -12, and +12 on the next day
    snapshot("r9", "12.00", "0.00", "PAID", f"{DAY2} 00:00:10", f"{DAY2} 00:01:00"),  # ~ nothing: sent again
    snapshot("s4", "5", "0", " paid ", f"{DAY1} 12:00:00", f"{DAY1} 12:00:01"),  # ~ +5
    snapshot("q2", "250.50", "250.50", "REFUNDED", f"{DAY1} 10:05:00", f"{DAY1} 12:00:00"),  # ~ -200.40
    '{"order_id":"t1","pay_amount":10',
    snapshot("t1", "10", "abc", "PAID", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01"),
    snapshot("t1", "10", "11", "PAID", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01"),
    snapshot("t1", "10", "0", "PAID", "2031-02-30 10:00:00", f"{DAY1} 13:00:01"),
    snapshot("t1", "10", "0", "SHIPPED", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01"),
    snapshot("t1", "10", "0", "PAID", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01"),  # ~ +10: what failed before left no trace
    snapshot({"a": 1}, "10", "0", "PAID", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01"),
    "",
    None,
    snapshot("u5", "", "1", "PART_REFUNDED", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01"),
    snapshot("v6", "3", "0", "PAID", f"{DAY1} 13:00:00", f"{DAY1} 13:00:01") + " tail",  # ~ +3: what follows the object is not read
]
D1, D2 = date(2031, 5, 20), date(2031, 5, 21)
EXPECTED = [
    ("p7", D1, "75.25"),
    ("p7", D1, "-75.25"),
    ("q2", D1, "250.50"),
    ("q2", D1, "-50.10"),
    ("q2", D1, "-200.40"),
    ("r9", D1, "12"),
    ("r9", D1, "-12"),
    ("r9", D2, "12"),
    ("s4", D1, "5"),
    ("t1", D1, "10"),
    ("v6", D1, "3"),
]
#: The arrival numbers of the messages that give deltas, one for each delta.
SENT = (1, 2, 3, 4, 6, 7, 7, 9, 10, 16, 21)
ERRORS = {
    11: "malformed JSON",
    12: "amount is not a number",
    13: "refund_amount exceeds pay_amount",
    14: "pay_time is malformed",
    15: "unknown order_status",
    17: "nested value in a field",
    18: "malformed JSON",
    19: "malformed JSON",
    20: "pay_amount must not be null",
}


def raw(spark):
    return spark.createDataFrame(list(enumerate(MESSAGES)), "seq long, value string")


def as_rows(frame):
    return [(r.order_id, r.biz_date, r.delta.normalize()) for r in sorted(frame.collect(), key=lambda r: (r.order_id, r.seq, r.part))]


def wanted():
    return [(o, d, Decimal(x).normalize()) for o, d, x in EXPECTED]


def test_deltas_and_dead_letters(spark):
    clean, dirty = orders.split_dirty(orders.validated(orders.parse_orders(raw(spark))))
    assert as_rows(orders.deltas(orders.contributions(clean))) == wanted()
    errors = {r.seq: r.error for r in dirty.collect()}
    assert errors == ERRORS
    totals = {r.biz_date: r.gmv for r in orders.net_gmv(raw(spark)).collect()}
    assert totals == {D1: Decimal("18.00"), D2: Decimal("12.00")}


def test_strict_parsing_and_contract(spark):
    with pytest.raises(Exception, match=r"message \d+: "):
        orders.parse_orders(raw(spark), strict=True).collect()
    full = {"order_id": "w1", "pay_amount": "4", "refund_amount": "0", "order_status": "PAID", "pay_time": f"{DAY1} 10:00:00", "update_time": f"{DAY1} 10:00:01", "record_grain": "ORDER", "currency_code": "CNY", "event_id": "e", "order_version": "1"}
    changes = [{}, {"order_version": "2", "pay_amount": "6"}, {"record_grain": "ITEM"}, {"currency_code": "EUR"}, {"order_version": "x"}, {"event_id": " "}, {"order_version": "2", "pay_amount": "9"}]
    rows = spark.createDataFrame([(i, json.dumps(full | c)) for i, c in enumerate(changes)], "seq long, value string")
    clean, dirty = orders.split_dirty(orders.validated(orders.parse_orders(rows), contract=True))
    assert {r.seq: r.error for r in dirty.collect()} == {2: "record_grain must be ORDER", 3: "currency_code must be CNY", 4: "order_version is not a number", 5: "event_id is missing"}
    # two versions within one second both count; the resent version does not
    assert [str(d[2]) for d in as_rows(orders.deltas(orders.contributions(clean, version_column="order_version")))] == ["4", "2"]
    loose, _ = orders.split_dirty(orders.validated(orders.parse_orders(rows)))
    assert [r.seq for r in orders.unversioned_after_versioned(loose, "order_version").collect()] == [4]


def test_running_sums_in_spans(spark):
    rng = random.Random(5)
    steps = [(s, 0, D1 if rng.random() < 0.6 else D2, Decimal(rng.randint(-900, 800)) / 100, rng.choice([-1, 1])) for s in range(400)]
    rows = spark.createDataFrame(steps, "seq long, part int, dt date, gmv decimal(18,2), orders long")
    want, held = {}, {}
    for s, _, d, g, n in steps:
        gmv, count = held.get(d, (Decimal(0), 0))
        held[d] = max(gmv + g, Decimal(0)), max(count + n, 0)
        want[s] = (d, *held[d])
    assert min(w[1] for w in want.values()) == 0 and sum(w[1] == 0 for w in want.values()) > 20  # the clamp binds
    for span in (7, 1 << 20):
        money = {"_g": "decimal(18,2)", "_n": "bigint"}
        free = orders.running(rows.select("seq", "part", "dt", F.col("gmv").alias("_g"), F.col("orders").alias("_n")), "dt", ("seq", "part"), money, span)
        got = {r.seq: (r.dt, r._g_sum - min(Decimal(0), r._g_least), r._n_sum - min(0, r._n_least)) for r in free.collect()}
        assert got == want
    assert {r.seq: (r.dt, r.gmv, r.paid_order_count) for r in orders.clamped_running(rows).collect()} == want


def test_corrections_of_one_day(spark):
    rows = [("a", "PAID", "10.00", "0", f"{DAY1} 10:00:00"), ("b", "FINISHED", "4.00", "1.50", f"{DAY1} 11:00:00"), ("a", "PAID", "10.00", "0", f"{DAY1} 10:00:00"), ("a", "PARTIALLY_REFUNDED", "10.00", "3", f"{DAY1} 10:00:00"), ("b", "PAID", "4.00", "1.00", f"{DAY1} 11:00:00"), ("c", "PAID", "7.00", "0", f"{DAY2} 00:00:00"), ("d", "paid", "7.00", "0", f"{DAY1} 00:00:00"), (" ", "PAID", "7.00", "0", f"{DAY1} 00:00:00")]
    raw = spark.createDataFrame([(i, json.dumps(dict(zip(("order_id", "order_status", "pay_amount", "refund_amount", "pay_time"), r, strict=True)))) for i, r in enumerate(rows)], "seq long, value string")
    parsed = orders.parse_orders(raw)
    found = orders.corrections(orders.day_contribution(parsed, F.lit(DAY1).cast("date")))
    got = [(r.seq, r.part, r.order_id, str(r.gmv), r.orders) for r in found.orderBy("seq", "part").collect()]
    assert got == [(0, 1, "a", "10.00", 1), (1, 1, "b", "2.50", 1), (3, 0, "a", "-10.00", -1), (4, 0, "b", "-2.50", -1), (4, 1, "b", "3.00", 1)]


def test_words_and_blanks(spark):
    rows = spark.createDataFrame([(1, " "), (2, "   "), (3, ""), (4, None), (5, " a"), (6, "a  b "), (7, "\u2003\x1c"), (8, "\u00a0")], "id long, t string")
    got = {r.id: (r.w, r.white) for r in rows.select("id", words(F.col("t")).alias("w"), is_white(F.col("t")).alias("white")).collect()}
    assert got == {1: ([], True), 2: ([], True), 3: ([""], True), 4: (None, True), 5: (["", "a"], False), 6: (["a", "", "b"], False), 7: (["\u2003\x1c"], True), 8: (["\u00a0"], False)}
    assert spark.range(1).select(local_text(F.lit(1_000), "Asia/Shanghai").alias("t")).first().t == "1970-01-01 08:00:01"


def test_short_pay_times_are_dead_letters(spark):
    rows = [(i, json.dumps({"order_id": "a", "order_status": "PAID", "pay_amount": "1", "pay_time": t})) for i, t in enumerate(["2031-05-20 10:00:00", "2031-5-2", ""])]
    parsed = orders.parse_orders(spark.createDataFrame(rows, "seq long, value string"))
    assert [r.seq for r in orders.short_pay_times(parsed).orderBy("seq").collect()] == [1, 2]
    assert [str(r.gmv) for r in orders.gross_gmv(parsed).collect()] == ["1.00"]


def test_streamed_deltas_equal_batch(spark, tmp_path):
    out, folder = [], str(tmp_path / "in")
    rows = raw(spark)
    for low, high in ((0, 8), (8, len(MESSAGES))):  # the second run goes on from the checkpoint of the first
        for part in (rows.filter(f"seq >= {low} and seq < {high} and seq % 8 < 3"), rows.filter(f"seq >= {low} and seq < {high} and seq % 8 >= 3")):
            part.coalesce(1).write.mode("append").parquet(folder)
        stream = delta_stream(spark.readStream.schema("seq long, value string").option("maxFilesPerTrigger", 1).parquet(folder), Settings())
        query = stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
        end = time.time() + 60
        while time.time() < end and sum(r.seq < high for r in out) < sum(w < high for w in SENT) and query.exception() is None:
            time.sleep(0.3)
        query.stop()
        assert query.exception() is None
    assert as_rows(spark.createDataFrame(out, DELTA)) == wanted()


def unpaid(seq, order, minute, status="UNPAID", paid=None):
    return seq, json.dumps({"order_id": order, "order_status": status, "create_time": f"{DAY1} 08:{minute:02d}:00", "pay_time": f"{DAY1} 08:{paid:02d}:00" if paid else ""})


def test_unpaid_timeouts(spark, tmp_path):
    data = [unpaid(1, "a", 0), unpaid(2, "b", 0), unpaid(3, "b", 0, "PAID", 0 or 1), unpaid(4, "c", 30), unpaid(5, "d", 50, "CANCELLED"), unpaid(6, "e", 59)]
    events = order_events(orders.parse_orders(spark.createDataFrame(data, "seq long, value string")).filter("error is null"), "Asia/Shanghai")
    named = lambda f: sorted(r.order_id for r in f.collect())
    assert named(unpaid_timeouts(events, 60_000)) == ["a", "c", "e"]
    assert named(unpaid_timeouts_exact(events, 60_000, 120_000)) == ["a", "c", "e"]
    folder, out = str(tmp_path / "in"), []
    for s in range(1, 7):
        spark.createDataFrame([x for x in data if x[0] == s], "seq long, value string").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema("seq long, value string").option("maxFilesPerTrigger", 1).parquet(folder)
    timed = order_events(orders.parse_orders(source).filter("error is null"), "Asia/Shanghai")
    query = timeout_stream(timed, Settings()).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert sorted(r.timeout_event_id for r in out) == ["a_UNPAID_ORDER_10MIN", "c_UNPAID_ORDER_10MIN"]  # e's deadline is past the last watermark


def test_generator_and_upsert(spark, tmp_path):
    made = mock_orders(spark, 500)
    assert made.count() == mock_orders(spark, 500).intersect(made).count() > 900
    clean, dirty = orders.split_dirty(orders.validated(orders.parse_orders(as_json(made))))
    assert dirty.isEmpty()
    sink = keyed_upsert(str(tmp_path / "t"), "order_id", "seq")
    rows = clean.select("order_id", "seq", "order_status")
    sink(rows.filter("seq % 8 = 1"), 0)
    sink(rows.filter("seq % 8 > 1"), 1)
    sink(rows.filter("seq % 8 > 1"), 1)
    table = read_upserted(spark, str(tmp_path / "t"))
    assert table.count() == 500
    assert table.join(rows.groupBy("order_id").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq"), ["order_id", "seq"]).count() == 500


def test_settings_and_adapters():
    layer = read_properties("# c\nzone = UTC\nrepeat_count=5\nrisk_count=\n")
    found = load_settings(layer, environ={"TIDELEDGER_REPEAT_COUNT": "7"})
    assert (found.zone, found.repeat_count, found.risk_count) == ("UTC", 7, Settings().risk_count)
    assert [starting_offsets(x) for x in ("Latest", "committed")] == ["latest", "earliest"]
    assert "ON CONFLICT (id) DO UPDATE SET a = EXCLUDED.a" in upsert_statement("t", "id", ["id", "a"])
    for bad in (lambda: starting_offsets("soon"), lambda: required({"k": " "}, "k"), lambda: upsert_statement("t; drop", "id", [])):
        try:
            bad()
        except (ValueError, KeyError):
            continue
        raise AssertionError
