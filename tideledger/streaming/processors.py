"""Streaming twins of the operators: keyed state and timers through transformWithState.

Rows of one key in one micro-batch come in no particular order after the
shuffle, so each processor sorts them: by `seq`, or by event time where two
sources meet, whose arrival numbers do not compare. Processing time is that of
the micro-batch. State expires by the engine's TTL, which exists in
processing-time mode only; the unpaid wait, which runs on event time, keeps the
time of its last write and is ignored once that is too old.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import date, datetime, timezone
from decimal import Decimal
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideledger.config import Settings
from tideledger.functions.text import is_blank
from tideledger.functions.times import local_datetime
from tideledger.operators import marketing, orders
from tideledger.operators.timeouts import RULE_CODE, TIMEOUT_FIELDS, is_settled, word_counts

DELTA = "order_id string, seq long, part int, biz_date date, delta decimal(38,10)"
TOTAL = "biz_date date, gmv decimal(18,2), update_ms long"
CORRECTION = "order_id string, seq long, part int, dt date, gmv decimal(18,2), orders long"
SNAPSHOT = "dt date, stat_ms long, gmv decimal(18,2), paid_order_count long"
CANDIDATE = "user_id long, sku_id long, event_time long, rule_code string, trigger_time long, source_event_id string, reason string, seq long"
TRIGGER = "trigger_id string, user_id long, sku_id long, rule_code string, reason string, trigger_time_ms long"


def _list(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r.seq)


def _day(ms: int, zone: str) -> date:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).astimezone(ZoneInfo(zone)).date()


def _next_boundary(ms: int, every_ms: int) -> int:
    return (ms // every_ms + 1) * every_ms


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class ContributionProcessor(_Processor):
    """Signed daily deltas of one order: version gate, then change, or revocation and addition."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "biz_date date, amount decimal(38,10), version timestamp_ntz", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old_date, old, latest = self.held.get() or (None, Decimal(0), None)
        changed = False
        for row in _list(rows):
            if latest is not None and row.version <= latest:
                continue
            day = row.pay_date or old_date
            parts = [(0, day, row.contribution - old)] if day == old_date else [(0, old_date, -old), (1, day, row.contribution)]
            for part, when, amount in parts:
                if when is not None and amount != 0:
                    yield Row(order_id=key[0], seq=row.seq, part=part, biz_date=when, delta=amount)
            old_date, old, latest, changed = day, row.contribution, row.version, True
        if changed:
            self.held.update((old_date, old, latest))


def delta_stream(raw: DataFrame, settings: Settings) -> DataFrame:
    """Deltas of a stream of (seq, value); the clean rows only, as in batch."""
    clean, _ = orders.split_dirty(orders.validated(orders.parse_orders(raw)))
    rows = clean.select(
        "order_id",
        "seq",
        orders.contribution(settings.deduct_refunds).alias("contribution"),
        F.to_date(local_datetime(F.col("pay_time"))).alias("pay_date"),
        local_datetime(F.col("update_time")).alias("version"),
    )
    processor = ContributionProcessor(settings.order_state_ttl_ms)
    return rows.groupBy("order_id").transformWithState(processor, DELTA, "append", "processingTime")


class DailyTotalProcessor(_Processor):
    """One day's running total, given out at most once an interval and only if it changed. It never expires."""

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "gmv decimal(38,10)")
        self.due = handle.getValueState("due", "at_ms long")
        self.dirty = handle.getValueState("dirty", "dirty boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (total,) = self.total.get() or (Decimal(0),)
        self.total.update((sum((r.delta for r in rows), total),))
        self.dirty.update((True,))
        if not self.due.exists():
            at = _next_boundary(timerValues.getCurrentProcessingTimeInMs(), self.every_ms)
            self.due.update((at,))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.due.get()
        if held is None or held[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.due.clear()
        if self.dirty.exists() and self.dirty.get()[0]:
            self.dirty.update((False,))
            yield Row(biz_date=key[0], gmv=self.total.get()[0].quantize(Decimal("0.01"), "ROUND_HALF_UP"), update_ms=held[0])


def total_stream(deltas: DataFrame, settings: Settings) -> DataFrame:
    """(biz_date, gmv, update_ms): a day's total at the interval's boundaries after changes."""
    return deltas.select("biz_date", "delta").groupBy("biz_date").transformWithState(DailyTotalProcessor(settings.output_every_ms), TOTAL, "append", "processingTime")


class CorrectionProcessor(_Processor):
    """One order's share in today's GMV: reversal of what it gave before, then what it gives now.

    Today is the day of processing, so an order paid yesterday that comes again
    takes its share of yesterday back. `today` fixes the day instead.
    """

    def __init__(self, zone: str, ttl_ms: int, today: date | None = None) -> None:
        self.zone, self.ttl_ms, self.today = zone, ttl_ms, today

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("share", "dt date, gmv decimal(18,2)", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        today = self.today or _day(timerValues.getCurrentProcessingTimeInMs(), self.zone)
        old = self.held.get()
        for row in _list(rows):
            new = (today, row.net) if row.positive and row.pay_date == today else None
            if new == old:
                continue
            if old is not None:
                yield Row(order_id=key[0], seq=row.seq, part=0, dt=old[0], gmv=-old[1], orders=-1)
            if new is not None:
                yield Row(order_id=key[0], seq=row.seq, part=1, dt=new[0], gmv=new[1], orders=1)
            old = new
        if old is None:
            self.held.clear()
        else:
            self.held.update(old)


def correction_stream(parsed: DataFrame, settings: Settings, today: date | None = None) -> DataFrame:
    """Corrections of a stream of parsed orders."""
    net, positive = orders.day_share()
    rows = parsed.filter(~is_blank(F.col("order_id"))).select("order_id", "seq", net.alias("net"), positive.alias("positive"), F.to_date(local_datetime(F.col("pay_time"))).alias("pay_date"))
    return rows.groupBy("order_id").transformWithState(CorrectionProcessor(settings.zone, settings.day_state_ttl_ms, today), CORRECTION, "append", "processingTime")


class TodayProcessor(_Processor):
    """One day's total and order count, held at 0 or more after every step; a snapshot at every boundary while it is today.

    At the first boundary after the day its state goes.
    """

    def __init__(self, zone: str, every_ms: int, ttl_ms: int, today: date | None = None) -> None:
        self.zone, self.every_ms, self.ttl_ms, self.today = zone, every_ms, ttl_ms, today

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("total", "gmv decimal(18,2), orders long", self.ttl_ms)
        self.due = handle.getValueState("due", "at_ms long", self.ttl_ms)

    def _register(self, now: int) -> None:
        at = _next_boundary(now, self.every_ms)
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        gmv, count = self.held.get() or (Decimal("0.00"), 0)
        for row in sorted(rows, key=lambda r: (r.seq, r.part)):
            gmv, count = max(gmv + row.gmv, Decimal("0.00")), max(count + row.orders, 0)
        self.held.update((gmv, count))
        if not self.due.exists():
            self._register(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, now = self.due.get(), timerValues.getCurrentProcessingTimeInMs()
        if due is None or due[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        if key[0] != (self.today or _day(now, self.zone)):
            self.held.clear()
            self.due.clear()
            return
        gmv, count = self.held.get() or (Decimal("0.00"), 0)
        self._register(now)
        yield Row(dt=key[0], stat_ms=due[0], gmv=gmv, paid_order_count=count)


def today_stream(corrections: DataFrame, settings: Settings, today: date | None = None) -> DataFrame:
    """Snapshots of a stream of corrections."""
    processor = TodayProcessor(settings.zone, settings.output_every_ms, settings.day_state_ttl_ms, today)
    return corrections.select("dt", "seq", "part", "gmv", "orders").groupBy("dt").transformWithState(processor, SNAPSHOT, "append", "processingTime")


class UserSkuProcessor(_Processor):
    """A user's carts of one item: repeated within the window, or left without a payment until the timer.

    A payment cancels the timer and empties the window; a later cart starts the
    wait anew. The window has no upper bound: carts count in order of arrival.
    """

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "event_time long, seq long, due_ms long", self.s.cart_ttl_ms)
        self.recent = handle.getListState("recent", "event_time long", self.s.cart_ttl_ms)
        self.seen = handle.getMapState("seen", "event_id string", "seen boolean", self.s.dedup_ttl_ms)

    def _repeated(self, event_id: str | None) -> bool:
        if not (event_id or "").strip(marketing.CONTROLS):
            return False
        if self.seen.containsKey((event_id,)):
            return True
        self.seen.updateValue((event_id,), (True,))
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for row in sorted(rows, key=lambda r: (r.event_time, r.seq)):
            if self._repeated(row.event_id):
                continue
            if (held := self.pending.get()) is not None:
                self.handle.deleteTimer(held[2])
                self.pending.clear()
            if row.is_pay:
                self.recent.clear()
                continue
            due = now + self.s.abandon_after_ms
            self.pending.update((row.event_time, row.seq, due))
            self.handle.registerTimer(due)
            times = [t for (t,) in self.recent.get() if t >= row.event_time - self.s.repeat_window_ms] + [row.event_time]
            self.recent.put([(t,) for t in times])
            if len(times) >= self.s.repeat_count:
                yield Row(user_id=key[0], sku_id=key[1], event_time=row.event_time, rule_code=marketing.REPEAT, trigger_time=0, source_event_id=row.event_id, reason=marketing.REASONS[marketing.REPEAT], seq=row.seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.pending.get()
        if held is None or held[2] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.pending.clear()
        yield Row(user_id=key[0], sku_id=key[1], event_time=held[0], rule_code=marketing.ABANDON, trigger_time=held[2], source_event_id=None, reason=marketing.REASONS[marketing.ABANDON], seq=held[1])


def candidate_stream(carts: DataFrame, pays: DataFrame, settings: Settings) -> DataFrame:
    """Candidates of a stream of carts and one of payments."""
    shape = lambda df, pay: df.select("user_id", "sku_id", "seq", "event_id", "event_time", F.lit(pay).alias("is_pay"))
    both = shape(carts, False).unionByName(shape(pays, True))
    return both.groupBy("user_id", "sku_id").transformWithState(UserSkuProcessor(settings), CANDIDATE, "append", "processingTime")


class FrequencyProcessor(_Processor):
    """Which candidates of one user may be pushed, given what was pushed before; time is that of processing."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.s.push_ttl_ms
        self.by_rule = handle.getMapState("by_rule", "rule_code string", "at_ms long", ttl)
        self.by_sku = handle.getMapState("by_sku", "rule_sku string", "at_ms long", ttl)
        self.pushes = handle.getListState("pushes", "at_ms long", ttl)
        self.risk = handle.getListState("risk", "at_ms long", ttl)

    def _last(self, state, name: str) -> int | None:
        found = state.getValue((name,)) if state.containsKey((name,)) else None
        return None if found is None else found[0]

    def _blocked(self, rule: str, sku: int, now: int, risk: list[int]) -> bool:
        last, last_sku = self._last(self.by_rule, rule), self._last(self.by_sku, f"{rule}_{sku}")
        today = sum(_day(t, self.s.zone) == _day(now, self.s.zone) for (t,) in self.pushes.get())
        return (
            (last is not None and now - last < self.s.same_rule_ms)
            or (last_sku is not None and now - last_sku < self.s.same_sku_ms)
            or today >= self.s.daily_pushes
            or len(risk) >= self.s.risk_count
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for row in sorted(rows, key=lambda r: (r.event_time, r.seq, r.rule_code)):
            risk = [t for (t,) in self.risk.get() if now - t <= self.s.risk_window_ms]
            if row.rule_code == marketing.ABANDON:  # counted even if the push is held back
                risk.append(now)
                self.risk.put([(t,) for t in risk])
            if self._blocked(row.rule_code, row.sku_id, now, risk):
                continue
            self.by_rule.updateValue((row.rule_code,), (now,))
            self.by_sku.updateValue((f"{row.rule_code}_{row.sku_id}",), (now,))
            day = _day(now, self.s.zone)
            today = [t for (t,) in self.pushes.get() if _day(t, self.s.zone) == day]
            self.pushes.put([(t,) for t in [*today, now]])
            name = f"{key[0]}_{row.sku_id}_{row.rule_code}_{day.year}W{day.isocalendar().week}"
            yield Row(trigger_id=name, user_id=key[0], sku_id=row.sku_id, rule_code=row.rule_code, reason=row.reason, trigger_time_ms=now)


def trigger_stream(candidates: DataFrame, settings: Settings) -> DataFrame:
    """Triggers of a stream of candidates."""
    rows = candidates.select("user_id", "sku_id", "event_time", "rule_code", "reason", "seq")
    return rows.groupBy("user_id").transformWithState(FrequencyProcessor(settings), TRIGGER, "append", "processingTime")


TIMEOUT = T.StructType([T.StructField(name, T.LongType() if name.endswith("_ms") else T.StringType()) for name in TIMEOUT_FIELDS])
CARRIED = ("user_id", "sku_id", "pay_amount", "order_status", "create_time", "timeout_time", "dt")


class TimeoutProcessor(_Processor):
    """One order's wait for its payment: an unpaid row sets the timer, a settled one clears it.

    A wait whose last write lies further back than the TTL in processing time
    has expired: its timer does nothing.
    """

    def __init__(self, timeout_ms: int, ttl_ms: int) -> None:
        self.timeout_ms, self.ttl_ms = timeout_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "create_ms long, due_ms long, written_ms long, " + ", ".join(f"{c} string" for c in CARRIED))

    @staticmethod
    def now_ms() -> int:
        return time.time_ns() // 1_000_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in _list(rows):
            if (held := self.pending.get()) is not None:
                self.handle.deleteTimer(held[1])
                self.pending.clear()
            if not row.settled:
                due = row.create_ms + self.timeout_ms
                self.pending.update((row.create_ms, due, self.now_ms(), *[row[c] for c in CARRIED]))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.pending.get()
        if held is None or held[1] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.pending.clear()
        if self.now_ms() - held[2] > self.ttl_ms:
            return
        carried = dict(zip(CARRIED, held[3:], strict=True))
        yield Row(**{c: v for c, v in ({"timeout_event_id": f"{key[0]}_{RULE_CODE}", "order_id": key[0], "rule_code": RULE_CODE, "create_time_ms": held[0], "timeout_time_ms": held[1]} | carried).items() if c in TIMEOUT_FIELDS})


def timeout_stream(events: DataFrame, settings: Settings) -> DataFrame:
    """Timeout events of a stream of order events (see operators.timeouts.order_events).

    The watermark column is left out before grouping, so that late rows are kept.
    """
    marked = events.withColumn("_at", F.timestamp_millis("event_ms")).withWatermark("_at", f"{settings.watermark_ms} milliseconds")
    carried: dict[str, Column] = {c: F.col(c).cast("string") for c in CARRIED if c in events.columns}
    rows = marked.select(
        "order_id",
        "seq",
        "create_ms",
        is_settled().alias("settled"),
        *[carried.get(c, F.lit(None).cast("string")).alias(c) for c in CARRIED],
        F.timestamp_millis(F.unix_millis("_at")).alias("at"),
    )
    processor = TimeoutProcessor(settings.unpaid_timeout_ms, settings.pending_ttl_ms)
    return rows.groupBy("order_id").transformWithState(processor, TIMEOUT, "append", "eventTime")


def word_stream(lines: DataFrame, width: str = "5 seconds", time_column: str = "timestamp", text: str = "value") -> DataFrame:
    """Words between single spaces of a socket stream, counted by the time they came in tumbling windows."""
    return word_counts(lines, time_column, text, width)
