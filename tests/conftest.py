import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL in DuckDB over the same tables."""
    import datetime
    import decimal
    import math
    from collections import Counter

    import duckdb

    def plain(v):
        if isinstance(v, (float, decimal.Decimal)):
            return "nan" if math.isnan(v) else round(float(v), 5)
        return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v

    def compare(df, sql, folder):
        con = duckdb.connect()
        for f in os.listdir(folder):
            con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        order = [want.columns.index(c) for c in df.columns]
        rows = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
        assert Counter(tuple(plain(v) for v in r) for r in df.collect()) == rows

    return compare
