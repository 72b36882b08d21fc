"""Keyed processors against their batch twins: a hand-driven clock for the rules, real streams for wiring and restarts."""

import json
import random
import time
from datetime import date
from decimal import Decimal

from pyspark.sql import Row
from pyspark.sql import functions as F

from tideledger import jobs
from tideledger.config import DAY_MS, HOUR_MS, Settings
from tideledger.operators import marketing, orders
from tideledger.sinks.adapters import read_upserted, topic_writer
from tideledger.sources import adapters as sources
from tideledger.streaming import processors as P


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, row):
        self.held = tuple(row)

    def clear(self):
        self.held = None

    def exists(self):
        return self.held is not None


class Items(Value):
    def get(self):
        return iter(self.held or ())

    def put(self, rows):
        self.held = list(rows)


class Named:
    def __init__(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value


class Clock:
    """A processor's handle, timer values and timers in one, driven by hand."""

    def __init__(self, make):
        self.now, self.timers, self.made, self.make = 0, {}, {}, make

    def of(self, key):
        if key not in self.made:
            self.current = key
            self.made[key] = self.make()
            self.timers[key] = set()
            self.made[key].init(_Handle(self, key))
        return self.made[key]

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.expiry

    def advance(self, to):
        """Fire what is due up to a time, in order."""
        out = []
        while due := [(t, k) for k, ts in self.timers.items() for t in ts if t <= to]:
            t, k = min(due, key=lambda d: (d[0], str(d[1])))
            self.timers[k].discard(t)
            self.now = self.expiry = t
            out += list(self.made[k].handleExpiredTimer(k, self, self) or ())
        self.now = to
        return out

    def feed(self, key, rows):
        return list(self.of(key).handleInputRows(key, iter(rows), self))


class _Handle:
    def __init__(self, clock, key):
        self.clock, self.key = clock, key

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Items()

    def getMapState(self, *_):
        return Named()

    def registerTimer(self, at):
        self.clock.timers[self.key].add(at)

    def deleteTimer(self, at):
        self.clock.timers[self.key].discard(at)


SETTINGS = Settings(abandon_after_ms=1_800_000)


def cart_events(seed, n=260):
    rng, at, rows = random.Random(seed), 1_900_000_000_000, []
    for seq in range(n):
        at += rng.choice([1, 7, 60, 600, 2400]) * 1000 + seq
        rows.append(Row(seq=seq, event_id=rng.choice([f"e{seq}", "twice", " ", None]) if seq % 9 == 0 else f"e{seq}", user_id=rng.randint(1, 3), sku_id=rng.randint(1, 2), event_time=at, is_pay=rng.random() < 0.2))
    return rows


def test_cart_rules_equal_batch(spark):
    rows = cart_events(1)
    clock, got = Clock(lambda: P.UserSkuProcessor(SETTINGS)), []
    for r in rows:  # event time stands in for the time of processing
        got += clock.advance(r.event_time)
        got += clock.feed((r.user_id, r.sku_id), [r])
    got += clock.advance(rows[-1].event_time + DAY_MS)
    frame = lambda pay: spark.createDataFrame([(r.seq, r.event_id, r.user_id, r.sku_id, r.event_time) for r in rows if r.is_pay == pay], "seq long, event_id string, user_id long, sku_id long, event_time long")
    want = marketing.candidates(frame(False), frame(True), SETTINGS).collect()
    shape = lambda r: (r.user_id, r.sku_id, r.event_time, r.seq, r.rule_code, r.trigger_time, r.source_event_id)
    assert sorted(map(str, map(shape, got))) == sorted(map(str, map(shape, want)))
    assert {r.rule_code for r in got} == {marketing.ABANDON, marketing.REPEAT}


def test_frequency_control_equals_batch(spark):
    rng, at, rows = random.Random(2), 1_900_000_000_000, []
    for seq in range(700):
        at += rng.choice([1, 20, 60, 600]) * 60_000
        rows.append(Row(user_id=rng.randint(1, 4), sku_id=rng.randint(1, 3), event_time=at, rule_code=rng.choice([marketing.ABANDON, marketing.REPEAT, "A", "B", "C", "D"]), reason="", seq=seq))
    short = Settings(same_rule_ms=3 * HOUR_MS, same_sku_ms=8 * HOUR_MS, risk_window_ms=2 * DAY_MS)
    clock, got = Clock(lambda: P.FrequencyProcessor(short)), []
    for r in rows:
        clock.now = r.event_time
        got += clock.feed((r.user_id,), [r])
    found = spark.createDataFrame([(r.user_id, r.sku_id, r.rule_code, r.event_time, r.seq) for r in rows], "user_id long, sku_id long, rule_code string, ts long, seq long")
    want = marketing.frequency_control(found, short).collect()
    assert sorted((r.trigger_id, r.trigger_time_ms) for r in got) == sorted((r.trigger_id, r.ts) for r in want)
    assert 50 < len(got) < 600


def test_week_of_new_year():
    clock = Clock(lambda: P.FrequencyProcessor(Settings()))
    clock.now = 1_798_732_800_000  # 2027-01-01 00:00 in Shanghai
    (sent,) = clock.feed((5,), [Row(sku_id=6, event_time=1, rule_code="R", reason="", seq=1)])
    assert sent.trigger_id == "5_6_R_2027W53"


def test_today_total_equals_batch(spark):
    rng, today, moves = random.Random(3), date(2031, 5, 20), []
    fix = Clock(lambda: P.CorrectionProcessor("Asia/Shanghai", DAY_MS, today))
    rows = [(f"o{rng.randint(1, 12)}", seq, Decimal(rng.randint(1, 900)) / 100, rng.random() < 0.7, date(2031, 5, rng.choice([19, 20, 20, 20]))) for seq in range(300)]
    for o, seq, net, positive, day in rows:
        moves += fix.feed((o,), [Row(seq=seq, net=net, positive=positive, pay_date=day)])
    parsed = spark.createDataFrame([(seq, o, net if positive and day == today else None, today if positive and day == today else None) for o, seq, net, positive, day in rows], "seq long, order_id string, gmv decimal(18,2), dt date")
    shape = lambda r: (r.seq, r.part, r.order_id, r.dt, r.gmv, r.orders)
    batch = orders.corrections(parsed.select("seq", "order_id", "dt", "gmv"))
    assert sorted(map(shape, moves)) == sorted(map(shape, batch.collect()))
    # deltas that would take the total below zero, one micro-batch each second
    deltas = [m for i, m in enumerate(sorted(moves, key=lambda r: (r.seq, r.part))) if i % 5]
    total, shown = Clock(lambda: P.TodayProcessor("Asia/Shanghai", 5_000, DAY_MS, today)), []
    for i, m in enumerate(deltas):
        shown += total.advance(1_000 * i)
        total.feed((today,), [m])
    shown += total.advance(1_000 * len(deltas) + 5_000)
    frame = spark.createDataFrame([shape(m) for m in deltas], "seq long, part int, order_id string, dt date, gmv decimal(18,2), orders long")
    steps = orders.clamped_running(frame).orderBy("seq", "part").collect()
    assert [s.stat_ms for s in shown] == list(range(5_000, 1_000 * len(deltas) + 5_001, 5_000))
    for s in shown:
        last = steps[min(s.stat_ms // 1_000, len(steps)) - 1]
        assert (s.gmv, s.paid_order_count) == (last.gmv, last.paid_order_count)


def test_today_ends_with_the_day():
    clock = Clock(lambda: P.TodayProcessor("Asia/Shanghai", 5_000, DAY_MS))
    midnight = 1_937_059_200_000  # a midnight in Shanghai
    clock.now = midnight - 7_000
    day = P._day(clock.now, "Asia/Shanghai")
    clock.feed((day,), [Row(seq=1, part=1, gmv=Decimal("3.00"), orders=1)])
    assert [s.stat_ms for s in clock.advance(midnight + 60_000)] == [midnight - 5_000] and not clock.made[(day,)].held.exists()


def test_daily_totals_only_after_changes():
    clock, day = Clock(lambda: P.DailyTotalProcessor(5_000)), date(2031, 5, 20)
    clock.now = 1_000
    clock.feed((day,), [Row(delta=Decimal("2.5")), Row(delta=Decimal("-4"))])
    shown = clock.advance(30_000)
    clock.feed((day,), [Row(delta=Decimal("1"))])
    shown += clock.advance(60_000)
    assert [(s.update_ms, str(s.gmv)) for s in shown] == [(5_000, "-1.50"), (35_000, "-0.50")]


def test_expired_wait_is_silent(monkeypatch):
    row = Row(seq=1, create_ms=100, settled=False, user_id="u", sku_id=None, pay_amount="1", order_status="UNPAID", create_time="c", timeout_time="t", dt="d")
    for later, n in ((500, 1), (2_000, 0)):
        clock = Clock(lambda: P.TimeoutProcessor(60, 1_000))
        monkeypatch.setattr(P.TimeoutProcessor, "now_ms", staticmethod(lambda: 0))
        clock.feed(("o",), [row])
        monkeypatch.setattr(P.TimeoutProcessor, "now_ms", staticmethod(lambda later=later: later))
        out = clock.advance(200)
        assert len(out) == n and all((r.timeout_event_id, r.user_id, r.timeout_time_ms, r.dt) == ("o_UNPAID_ORDER_10MIN", "u", 160, "d") for r in out)


def _wait_for(ready, queries, seconds=90):
    end = time.time() + seconds
    try:
        while time.time() < end and not ready():
            assert all(q.exception() is None for q in queries)
            time.sleep(0.5)
    finally:
        for q in queries:
            q.stop()
    return ready()


def test_marketing_job_end_to_end(spark, tmp_path):
    settings = Settings(message_dir=str(tmp_path / "m"), table_dir=str(tmp_path / "t"), checkpoint_dir=str(tmp_path / "c"), abandon_after_ms=3_000)
    cart = lambda user, n, at: json.dumps({"op": "c", "after": {"event_id": f"{user}-{n}", "user_id": user, "sku_id": 9, "event_time": f"2031-05-20 10:{at:02d}:00"}})
    pay = json.dumps({"op": "u", "after": {"order_id": 1, "user_id": 2, "sku_id": 9, "order_status": "PAID", "pay_time": "2031-05-20 10:30:00"}})
    send = lambda topic, values: topic_writer(spark, topic.name, "", settings.message_dir)(spark.createDataFrame([(None, v) for v in values], "key string, value string"), 0)
    send(sources.CARTS, [cart(1, 1, 1), cart(1, 2, 2), cart(1, 2, 2), cart(1, 3, 3), cart(2, 1, 1), cart(3, 1, 1), json.dumps({"op": "d", "after": None})])
    send(sources.PAYMENTS, [pay])
    queries = jobs.marketing_triggers(spark, settings, "500 milliseconds")
    sent = lambda: sorted(json.loads(r.value)["ruleCode"] + json.loads(r.value)["triggerId"][:2] for r in sources.message_files(spark, settings.message_dir, sources.TRIGGERS, streaming=False).collect()) if (tmp_path / "m" / sources.TRIGGERS.name).exists() else []
    want = ["ABANDON_CART_30MIN1_", "ABANDON_CART_30MIN3_", "REPEAT_CART_1H1_"]
    assert _wait_for(lambda: sent() == want, queries), sent()
    for q in jobs.trigger_loader(spark, settings, None):
        assert q.awaitTermination(60) and q.exception() is None
    table = read_upserted(spark, f"{settings.table_dir}/coupon_trigger")
    assert sorted(r.rule_code for r in table.collect()) == ["ABANDON_CART_30MIN", "ABANDON_CART_30MIN", "REPEAT_CART_1H"] and table.filter("dt is null or sku_id <> 9").isEmpty()


def test_net_gmv_job_goes_on_from_its_checkpoint(spark, tmp_path):
    settings = Settings(message_dir=str(tmp_path / "m"), table_dir=str(tmp_path / "t"), checkpoint_dir=str(tmp_path / "c"), output_every_ms=500)
    made = sources.as_json(sources.mock_orders(spark, 120)).collect()
    folder = tmp_path / "m" / sources.NET_ORDERS.name
    folder.mkdir(parents=True)
    raw = spark.createDataFrame(made, "seq long, value string")
    table = lambda: read_upserted(spark, f"{settings.table_dir}/daily_net_gmv")
    for low, high in ((0, 2), (2, 9)):
        part = [{"seq": r.seq, "value": r.value} for r in made if low <= r.seq % 8 < high] + ([] if low else [{"seq": -1, "value": "{"}])
        (folder / f"part{low}.json").write_text("\n".join(map(json.dumps, part)))
        seen = [json.loads(p)["seq"] for f in folder.iterdir() for p in f.read_text().splitlines()]
        want = {str(r.biz_date): r.gmv for r in orders.net_gmv(raw.filter(F.col("seq").isin(*seen))).collect()}
        got = lambda: {r.biz_date: r.gmv for r in table().collect()} if table() is not None else {}
        assert _wait_for(lambda want=want, got=got: got() == want, jobs.net_gmv(spark, settings, "500 milliseconds")), (got(), want)
    letters = spark.read.option("recursiveFileLookup", "true").parquet(f"{settings.table_dir}/dead_letters").collect()
    assert [(r.job, r.code, r.raw) for r in letters] == [("net_gmv", "MALFORMED_JSON", "{")]


def test_late_rows_count(spark, tmp_path):
    """A late unpaid order, whose deadline has passed, fires at the next advance."""
    settings = Settings(message_dir=str(tmp_path / "m"), checkpoint_dir=str(tmp_path / "c"))
    folder = tmp_path / "m" / sources.UNPAID_ORDERS.name
    folder.mkdir(parents=True)
    order = lambda name, minute: json.dumps({"seq": minute, "value": json.dumps({"order_id": name, "user_id": "u", "order_status": "UNPAID", "create_time": f"2031-05-20 10:{minute:02d}:00", "pay_time": ""})})
    for i, (name, minute) in enumerate([("early", 30), ("late", 1), ("next", 40), ("last", 55), ("end", 56)]):
        (folder / f"f{i}.json").write_text(order(name, minute))
        for q in jobs.unpaid_timeouts(spark, settings, None):
            assert q.awaitTermination(60) and q.exception() is None
    sent = [json.loads(r.value) for r in sources.message_files(spark, settings.message_dir, sources.TIMEOUTS, streaming=False).collect()]
    assert {"early", "late", "next"} <= {s["orderId"] for s in sent} and "end" not in {s["orderId"] for s in sent}
    assert all(s["userId"] == "u" and s["dt"] == "2031-05-20" and s["timeoutTimeMs"] - s["createTimeMs"] == 60_000 for s in sent)
    table = Settings(message_dir=settings.message_dir, checkpoint_dir=settings.checkpoint_dir, table_dir=str(tmp_path / "t"))
    for q in jobs.timeout_upserts(spark, table, None):
        assert q.awaitTermination(60) and q.exception() is None
    assert read_upserted(spark, f"{table.table_dir}/order_unpaid_timeout").count() == len({s["orderId"] for s in sent})


def test_gross_gmv_job(spark, tmp_path):
    settings = Settings(message_dir=str(tmp_path / "m"), table_dir=str(tmp_path / "t"), checkpoint_dir=str(tmp_path / "c"))
    made = sources.as_json(sources.mock_orders(spark, 60)).collect()
    folder = tmp_path / "m" / sources.GROSS_ORDERS.name
    folder.mkdir(parents=True)
    short = json.dumps({"order_id": "a", "order_status": "PAID", "pay_amount": "1", "pay_time": "soon"})
    lines = [{"seq": r.seq, "value": r.value} for r in made] + [{"seq": -1, "value": short}, {"seq": -2, "value": "["}]
    for i in range(2):  # the second run goes on from the first's checkpoint and adds what is new
        (folder / f"f{i}.json").write_text("\n".join(map(json.dumps, lines[i::2])))
        for q in jobs.gross_gmv(spark, settings, None):
            assert q.awaitTermination(90) and q.exception() is None
    raw = spark.createDataFrame([(x["seq"], x["value"]) for x in lines], "seq long, value string")
    want = {r.biz_date: r.gmv for r in orders.gross_gmv(orders.parse_orders(raw).filter("error is null")).collect()}
    assert want and {r.biz_date: r.gmv for r in read_upserted(spark, f"{settings.table_dir}/daily_gross_gmv").collect()} == want
    letters = spark.read.option("recursiveFileLookup", "true").parquet(f"{settings.table_dir}/gross_dead_letters")
    assert sorted(r.code for r in letters.collect()) == ["MALFORMED_JSON", "PAY_TIME_IS_TOO_SHORT"]


def test_today_job(spark, tmp_path):
    settings = Settings(message_dir=str(tmp_path / "m"), table_dir=str(tmp_path / "t"), checkpoint_dir=str(tmp_path / "c"), output_every_ms=1_000)
    now = P._day(int(time.time() * 1000), settings.zone)
    order = lambda name, amount, refund, status="PAID", day=now: json.dumps({"order_id": name, "order_status": status, "pay_amount": amount, "refund_amount": refund, "pay_time": f"{day} 00:00:01"})
    values = [order("a", "10", "0"), order("b", "4.5", "1"), order("c", "9", "0", day=date(2001, 1, 1)), order("a", "10", "10", "REFUNDED"), order("d", "2", "0", "FINISHED")]
    folder = tmp_path / "m" / sources.TODAY_ORDERS.name
    folder.mkdir(parents=True)
    (folder / "f.json").write_text("\n".join(json.dumps({"seq": i, "value": v}) for i, v in enumerate(values)))
    path = tmp_path / "t" / "today_gmv"
    shown = lambda: spark.read.option("recursiveFileLookup", "true").parquet(str(path)).collect() if list(path.glob("*/_SUCCESS")) else []
    ready = lambda: any((str(r.gmv), r.paid_order_count) == ("5.50", 2) for r in shown())
    assert _wait_for(ready, jobs.today_gmv(spark, settings, "500 milliseconds")), shown()
    assert {r.dt for r in shown()} <= {now}
