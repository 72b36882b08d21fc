"""Sinks: databases, labelled loads, message files, dead letters; generator and settings."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tideledger import jobs
from tideledger.config import Credentials, Settings, load_profile
from tideledger.operators import orders, timeouts
from tideledger.sinks import adapters as sinks
from tideledger.sources import adapters as sources


def test_database_upsert(spark):
    """Against the embedded database that Spark brings along."""
    base = sinks.Database("jdbc:derby:memory:tide;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", dialect="standard")
    base.run(spark, [sinks.create_statement("waits", "event_id", {"event_id": "VARCHAR(40)", "status": "VARCHAR(20)"}).replace("IF NOT EXISTS ", "")])
    write = sinks.database_upsert(base, "waits", "event_id", "seq", {"event_id": "VARCHAR(40)", "status": "VARCHAR(20)"})
    rows = lambda *r: spark.createDataFrame(r, "seq long, event_id string, status string")
    for batch in (rows((1, "a", "UNPAID"), (3, "a", "LATER"), (2, "b", "UNPAID")), rows((4, "b", "CLOSED"), (5, "c", "UNPAID")), rows((4, "b", "CLOSED"), (5, "c", "UNPAID"))):
        write(batch, 0)
    assert base.run(spark, [], "SELECT event_id, status FROM waits ORDER BY event_id") == [("a", "LATER"), ("b", "CLOSED"), ("c", "UNPAID")]


def test_statements():
    (merge,) = sinks.merge_from_staging("t", "t_stage", "id", ["id", "a"])
    assert merge.startswith('INSERT INTO t (id, a) SELECT "id", "a" FROM t_stage ON CONFLICT (id) DO UPDATE SET a = EXCLUDED.a')
    assert "CREATE TABLE IF NOT EXISTS t (id TEXT, updated_at" in sinks.create_statement("t", "id", {"id": "TEXT"})
    with pytest.raises(ValueError):
        sinks.create_statement("t; drop", "id", {})


class Store(BaseHTTPRequestHandler):
    """A table that takes labelled loads: rows count once their transaction is committed."""

    labels, open_, rows, failures = {}, {}, [], 2
    lock = threading.Lock()

    def do_PUT(self):
        body = self.rfile.read(int(self.headers["Content-Length"] or 0)).decode()
        with self.lock:
            if Store.failures:
                Store.failures -= 1
                return self.send_error(503)
            if self.path.endswith("_2pc"):
                Store.rows += Store.open_.pop(int(self.headers["txn_id"]), [])
                reply = {"status": "Success"}
            elif self.headers["label"] in Store.labels:
                txn = Store.labels[self.headers["label"]]
                reply = {"Status": "Label Already Exists", "ExistingJobStatus": "PRECOMMITTED" if txn in Store.open_ else "FINISHED", "TxnId": txn}
            else:
                assert self.headers["two_phase_commit"] == "true" and self.headers["Authorization"] == "Basic dTpw"
                txn = Store.labels[self.headers["label"]] = len(Store.labels) + 1
                Store.open_[txn] = [json.loads(x) for x in body.splitlines()]
                reply = {"Status": "Success", "TxnId": txn}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *_):
        pass


def test_labelled_load(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        target = sinks.LoadTarget(f"http://127.0.0.1:{server.server_port}", "mall", "daily", Credentials("u", "p"), "daily-v1", rows=7)
        batch = spark.range(300).select(F.col("id").alias("n"), F.lit(None).cast("string").alias("x"))
        for epoch in (0, 0, 1):  # the repeated batch adds nothing
            sinks.labelled_load(target)(batch, epoch)
        assert sorted(r["n"] for r in Store.rows) == sorted([*range(300)] * 2) and all(r["x"] is None for r in Store.rows) and not Store.open_
    finally:
        server.shutdown()
    assert "p'" not in repr(target) and "password" not in repr(target)


def test_timeout_messages_and_back(spark, tmp_path):
    value = json.dumps({"order_id": "o", "user_id": "u", "order_status": "UNPAID", "pay_amount": "3.5", "create_time": "2031-05-20 10:00:00", "pay_time": ""})
    parsed = orders.parse_orders(spark.createDataFrame([(1, value)], "seq long, value string"))
    events = timeouts.timeout_events(timeouts.order_events(parsed, "Asia/Shanghai"), 60_000).drop("seq")
    sent = sinks.timeout_messages(events)
    (message,) = sent.collect()
    assert list(json.loads(message.value)) == ["timeoutEventId", "orderId", "userId", "skuId", "payAmount", "orderStatus", "ruleCode", "createTime", "timeoutTime", "dt", "createTimeMs", "timeoutTimeMs"]
    bad = spark.createDataFrame([("k", '{"orderId":"x"}'), ("k", '{"timeoutEventId":"e","orderId":"x"}')], "key string, value string")
    sinks.topic_writer(spark, sources.TIMEOUTS.name, "", str(tmp_path))(sent.unionByName(bad), 0)
    back = timeouts.parse_timeout_events(sources.message_files(spark, str(tmp_path), sources.TIMEOUTS, streaming=False)).orderBy("order_id").collect()
    assert [(r.order_id, r.create_time_ms, r.timeout_time, r.dt) for r in back] == [("o", 1_937_008_800_000, "2031-05-20 10:01:00", "2031-05-20"), ("x", 0, None, None)]


def test_daily_messages_and_dead_letters(spark, capsys):
    totals = spark.createDataFrame([("2031-05-20", 1.5)], "biz_date string, gmv double")
    (m,) = sinks.daily_messages(totals, F.lit("now")).collect()
    assert json.loads(m.value) == {"biz_date": "2031-05-20", "gmv": 1.5, "update_time": "now"} and m.key == "2031-05-20"
    letters = sinks.dead_letters(spark.createDataFrame([(4, "{", "malformed JSON")], "seq long, value string, error string"), "job", "parse")
    assert [(r.job, r.stage, r.code, r.message, r.raw, r.seq) for r in letters.collect()] == [("job", "parse", "MALFORMED_JSON", "malformed JSON", "{", 4)]
    assert letters.drop("first_seen").schema.names == [c.split()[0] for c in sinks.DEAD_LETTER.split(", ")][:-1]
    sinks.printed("DIRTY ")(totals, 0)
    assert capsys.readouterr().out == "DIRTY {'biz_date': '2031-05-20', 'gmv': 1.5}\n"


def test_generator_topics(spark, tmp_path):
    settings = Settings(message_dir=str(tmp_path))
    jobs.mock_data(spark, settings, number=50, users=4, days=3)
    raw = sources.message_files(spark, settings.message_dir, sources.NET_ORDERS, streaming=False)
    clean, dirty = orders.split_dirty(orders.validated(orders.parse_orders(raw), contract=True))
    assert dirty.isEmpty() and clean.select("order_id").distinct().count() == 50
    assert sources.mock_users(spark, 4, 3).count() == sources.mock_activity(spark, 4, 3).count() == 12
    assert sources.mock_activity(spark, 4, 3).filter("substring(active_time, 1, 10) <> dt").isEmpty()
    with pytest.raises(RuntimeError):
        sinks.topic_writer(spark, "t", "localhost:1")
    assert not sinks.has_source(spark, "kafka") and sinks.has_source(spark, "parquet")


def test_topics_and_lines(spark, tmp_path):
    assert {t.start for t in sources.TOPICS.values()} <= set(sources.STARTS) and sources.kafka_options("h", "t", "Committed")["startingOffsets"] == "earliest"
    moments = spark.createDataFrame([(10, 5), (10, 6), (11, 1)], "ms long, offset long").select(sources.arrival(F.col("ms"), F.col("offset")).alias("seq")).collect()
    assert [r.seq for r in moments] == sorted(r.seq for r in moments)
    (tmp_path / "l.txt").write_text("a b\n\nc")
    assert sources.json_lines(spark, str(tmp_path)).count() == 3 and sources.json_lines(spark, str(tmp_path), True).isStreaming
    assert sources.socket_lines(spark, "localhost", 9).isStreaming


def test_profiles(tmp_path):
    (tmp_path / "settings.properties").write_text("repeat_count=4\nzone=UTC\n")
    (tmp_path / "settings-dev.properties").write_text("repeat_count=6\nrisk_count=\n")
    (tmp_path / "more.properties").write_text("risk_count=9\n")
    found = load_profile("dev", str(tmp_path), str(tmp_path / "more.properties"), {"TIDELEDGER_ZONE": "Asia/Tokyo"})
    assert (found.repeat_count, found.risk_count, found.zone) == (6, 9, "Asia/Tokyo")
    (tmp_path / "settings-bad.properties").write_text("table.password=x\n")
    for name, error in (("bad", ValueError), ("none", FileNotFoundError)):
        with pytest.raises(error):
            load_profile(name, str(tmp_path), environ={})
    with pytest.raises(KeyError):
        Credentials.of("tables", {"TIDELEDGER_TABLES_USER": "u", "TIDELEDGER_TABLES_PASSWORD": " "})
    assert "secret" not in repr(Credentials.of("tables", {"TIDELEDGER_TABLES_USER": "u", "TIDELEDGER_TABLES_PASSWORD": "secret"}))
