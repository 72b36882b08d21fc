from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from tideledger.session import ROCKSDB

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL over the smallest tables."""

    def check(query, sql: str) -> int:
        with duckdb.connect() as db:
            for path in glob.glob(f"{SMALL}/*.parquet"):
                db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
            found = db.execute(sql)
            names = [d[0] for d in found.description]
            theirs = [dict(zip(names, row, strict=True)) for row in found.fetchall()]
        frame = query(spark, SMALL)
        columns = sorted(frame.columns)
        assert sorted(names) == columns
        text = lambda rows: sorted([str(r[c]) for c in columns] for r in rows)
        ours = [r.asDict() for r in frame.collect()]
        assert text(ours) == text(theirs)
        return len(ours)

    return check
