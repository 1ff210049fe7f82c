import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Runs a query and its SQL on the smallest tables and compares the rows."""

    def check(name, frame, sql):
        columns = sorted(frame.columns)
        ours = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall())
        assert sorted(names) == columns, name
        assert ours == theirs, name

    return check
