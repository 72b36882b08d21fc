"""Sinks for foreachBatch: keyed upserts, appends, message topics, dead letters, databases and labelled HTTP loads.

Spark repeats a micro-batch whose commit it did not see, so every sink here may
get the same batch twice: upserts are by key, files are by epoch, loads by label.
"""

from __future__ import annotations

import base64
import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideledger.config import Credentials
from tideledger.operators.timeouts import latest

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
Write = Callable[[DataFrame, int], None]


def _names(*names: str) -> None:
    for name in names:
        if not NAME.fullmatch(name):
            raise ValueError(f"not a column or table name: {name}")


# serializers


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def json_of(columns: list[str], camel_case: bool = False) -> Column:
    """The columns as one JSON text, nulls included."""
    return F.to_json(F.struct(*[F.col(c).alias(camel(c) if camel_case else c) for c in columns]), {"ignoreNullFields": "false"})


def as_messages(rows: DataFrame, key: str, camel_case: bool = False) -> DataFrame:
    """Key and JSON value for a message sink; the key makes redelivery idempotent downstream."""
    return rows.select(F.col(key).cast("string").alias("key"), json_of(rows.columns, camel_case).alias("value"))


def trigger_messages(triggers: DataFrame) -> DataFrame:
    """Coupon triggers, camelCase."""
    return as_messages(triggers, "trigger_id", camel_case=True)


def timeout_messages(events: DataFrame) -> DataFrame:
    """Unpaid-order timeouts, camelCase."""
    return as_messages(events, "timeout_event_id", camel_case=True)


def daily_messages(totals: DataFrame, update_time: Column) -> DataFrame:
    """Daily totals as {biz_date, gmv, update_time}."""
    rows = totals.select(F.col("biz_date").cast("string").alias("biz_date"), "gmv", update_time.alias("update_time"))
    return as_messages(rows, "biz_date")


# files


def keyed_upsert(path: str, key: str, order: str) -> Write:
    """Keep the latest row of every key in versions under path, of equally late ones that of the later batch; replaying a batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = read_upserted(spark, path, epoch)
        rows = batch.withColumn("_order", F.struct(order, F.lit(1)))
        if earlier is not None:
            rows = earlier.withColumn("_order", F.struct(order, F.lit(0))).unionByName(rows, allowMissingColumns=True)
        latest(rows, key, "_order").drop("_order").write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return write


def read_upserted(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table as of the last epoch (before a given one), or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    epochs = sorted((int(p.getName().split("=")[1]), p.toString()) for p in done)
    usable = [p for e, p in epochs if before is None or e < before]
    return spark.read.parquet(usable[-1]) if usable else None


def append(path: str) -> Write:
    """Append snapshots; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return write


def printed(prefix: str = "", rows: int = 1000) -> Write:
    """Show a batch's first rows on the driver's output, each after the prefix."""

    def write(batch: DataFrame, epoch: int) -> None:
        for row in batch.limit(rows).collect():
            print(f"{prefix}{row.asDict()}")

    return write


DEAD_LETTER = "job string, stage string, code string, message string, raw string, seq long, first_seen timestamp"


def dead_letters(dirty: DataFrame, job: str, stage: str) -> DataFrame:
    """Rows (seq, value, error) in the shape of the dead-letter table; the code names the reason without spaces."""
    code = F.upper(F.regexp_replace("error", "[^A-Za-z0-9]+", "_"))
    return dirty.select(F.lit(job).alias("job"), F.lit(stage).alias("stage"), code.alias("code"), F.col("error").alias("message"), F.col("value").alias("raw"), "seq", F.current_timestamp().alias("first_seen"))


# message topics


def has_source(spark: SparkSession, name: str) -> bool:
    """Whether a data source of this name is on the class path."""
    loader = spark.sparkContext._jvm.org.apache.spark.sql.execution.datasources.DataSource
    try:
        loader.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
    except Exception:
        return False
    return True


def topic_writer(spark: SparkSession, topic: str, servers: str, message_dir: str = "") -> Write:
    """Write (key, value) messages to a topic: of the message store if its package is there, or else of files under message_dir.

    Delivery is at least once; consumers tell messages apart by key.
    """
    _names(topic)
    if not message_dir and not has_source(spark, "kafka"):
        raise RuntimeError("no message store: put its package on the class path or name a message_dir")

    def write(batch: DataFrame, epoch: int) -> None:
        if message_dir:
            numbered = batch.withColumn("seq", F.lit(epoch).cast("long") * F.lit(1 << 40) + F.monotonically_increasing_id() % F.lit(1 << 40))
            numbered.select("seq", "key", "value").write.mode("overwrite").json(f"{message_dir}/{topic}/epoch={epoch:012d}")
        else:
            batch.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("topic", topic).save()

    return write


# databases


def create_statement(table: str, key: str, columns: dict[str, str]) -> str:
    """CREATE TABLE IF NOT EXISTS with a primary key and the time of the last change."""
    _names(table, key, *columns)
    listed = ", ".join(f"{c} {kind}" for c, kind in columns.items())
    return f"CREATE TABLE IF NOT EXISTS {table} ({listed}, updated_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY ({key}))"


def upsert_statement(table: str, key: str, columns: list[str]) -> str:
    """PostgreSQL: insert, or overwrite the row of the same key."""
    _names(table, key, *columns)
    changes = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns if c != key)
    return f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join('?' for _ in columns)}) ON CONFLICT ({key}) DO UPDATE SET {changes}, updated_at = CURRENT_TIMESTAMP"


def merge_from_staging(table: str, staging: str, key: str, columns: list[str], dialect: str = "postgresql") -> list[str]:
    """Statements of one transaction that upsert a whole staged batch, whose columns Spark has made under quoted names."""
    _names(table, staging, key, *columns)
    listed, staged = ", ".join(columns), ", ".join(f'"{c}"' for c in columns)
    if dialect == "postgresql":
        changes = ", ".join(f"{c} = EXCLUDED.{c}" for c in columns if c != key)
        return [f"INSERT INTO {table} ({listed}) SELECT {staged} FROM {staging} ON CONFLICT ({key}) DO UPDATE SET {changes}, updated_at = CURRENT_TIMESTAMP"]
    return [f'DELETE FROM {table} WHERE {key} IN (SELECT "{key}" FROM {staging})', f"INSERT INTO {table} ({listed}, updated_at) SELECT {staged}, CURRENT_TIMESTAMP FROM {staging}"]


@dataclass(frozen=True)
class Database:
    url: str
    driver: str
    login: Credentials | None = None
    dialect: str = "postgresql"

    def options(self) -> dict[str, str]:
        given = {"url": self.url, "driver": self.driver}
        return given | ({"user": self.login.user, "password": self.login.password} if self.login else {})

    def run(self, spark: SparkSession, statements: list[str], query: str | None = None) -> list[tuple]:
        """Run statements in one transaction on the driver; the rows of a query after them."""
        jvm = spark.sparkContext._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.driver)
        given = jvm.java.util.Properties()
        if self.login:
            given.setProperty("user", self.login.user)
            given.setProperty("password", self.login.password)
        link = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            link.setAutoCommit(False)
            todo = link.createStatement()
            for statement in statements:
                todo.executeUpdate(statement)
            rows = []
            if query:
                found = todo.executeQuery(query)
                width = found.getMetaData().getColumnCount()
                while found.next():
                    rows.append(tuple(found.getString(i + 1) for i in range(width)))
            link.commit()
            return rows
        except Exception:
            link.rollback()
            raise
        finally:
            link.close()


def database_upsert(database: Database, table: str, key: str, order: str, columns: dict[str, str]) -> Write:
    """Stage the latest row of each key of a batch from the executors, then merge the stage in one transaction; columns: names and SQL types."""
    _names(table, key, order, *columns)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = latest(batch.select(*dict.fromkeys([key, order, *columns])), key, order).select(*columns)
        staging = f"{table}_stage"
        rows.write.format("jdbc").options(**database.options()).option("dbtable", staging).option("createTableColumnTypes", ", ".join(f"{c} {kind}" for c, kind in columns.items())).mode("overwrite").save()
        database.run(batch.sparkSession, merge_from_staging(table, staging, key, list(columns), database.dialect))

    return write


# labelled HTTP loads


def stream_load_headers(label: str, columns: list[str], two_phase: bool = False) -> dict[str, str]:
    """HTTP headers of a labelled load of JSON lines; the label makes a repeated batch a no-op."""
    _names(*columns)
    given = {"label": label, "format": "json", "read_json_by_line": "true", "columns": ",".join(columns), "Expect": "100-continue"}
    return given | ({"two_phase_commit": "true"} if two_phase else {})


@dataclass(frozen=True)
class LoadTarget:
    """A table that takes labelled loads over HTTP."""

    frontend: str
    database: str
    table: str
    login: Credentials
    label_prefix: str
    two_phase: bool = True
    retries: int = 3
    rows: int = 10_000

    def __post_init__(self) -> None:
        _names(self.database, self.table)
        if not re.fullmatch(r"[A-Za-z0-9_-]+", self.label_prefix):
            raise ValueError(f"not a label prefix: {self.label_prefix}")

    def _put(self, path: str, headers: dict[str, str], body: bytes = b"") -> dict:
        token = base64.b64encode(f"{self.login.user}:{self.login.password}".encode()).decode()
        request = urllib.request.Request(f"{self.frontend}/api/{self.database}/{path}", body, {"Authorization": f"Basic {token}", **headers}, method="PUT")
        last: Exception | None = None
        for _ in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=60) as reply:
                    return json.loads(reply.read())
            except OSError as error:
                last = error
        raise RuntimeError(f"load to {self.database}.{self.table} failed") from last

    def load(self, label: str, columns: list[str], lines: list[str]) -> int:
        """Send lines under a label; the transaction's number, or -1 if the label was loaded before."""
        reply = self._put(f"{self.table}/_stream_load", stream_load_headers(label, columns, self.two_phase), "\n".join(lines).encode())
        status = reply.get("Status")
        if status == "Label Already Exists":
            return int(reply["TxnId"]) if self.two_phase and reply.get("ExistingJobStatus") == "PRECOMMITTED" and "TxnId" in reply else -1
        if status not in ("Success", "Publish Timeout"):
            raise RuntimeError(f"load {label} was refused: {reply.get('Message')}")
        return int(reply.get("TxnId", -1))

    def commit(self, transaction: int) -> None:
        reply = self._put(f"{self.table}/_stream_load_2pc", {"txn_id": str(transaction), "txn_operation": "commit"})
        if str(reply.get("status", reply.get("Status"))).lower() != "success":
            raise RuntimeError(f"transaction {transaction} was not committed: {reply.get('msg')}")


def labelled_load(target: LoadTarget) -> Write:
    """Executors send a batch in labelled parts; the driver commits them once all have arrived.

    Labels name the epoch and the rows' place in a fixed order, so a repeated
    batch repeats its labels.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        columns = batch.columns
        lines = batch.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
        placed = lines.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(64)).cast("int")).repartition(64, "part").sortWithinPartitions("part", "line")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[str] = []
            at, number, done = None, 0, []

            def flush() -> None:
                if held:
                    done.append(target.load(f"{target.label_prefix}-{epoch}-{at}-{number}", columns, held))
                    held.clear()

            for rows in batches:
                for line, part in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if part != at or len(held) >= target.rows:
                        flush()
                        number = number + 1 if part == at else 0
                        at = part
                    held.append(line)
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["txn"])

        sent = [r.txn for r in placed.mapInArrow(send, "txn long").collect()]
        if target.two_phase:
            for transaction in sorted(t for t in sent if t >= 0):
                target.commit(transaction)

    return write
