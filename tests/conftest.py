import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame and a SQL text give the same rows, in any order."""

    def plain(x):
        if isinstance(x, float):
            return round(x, 9) + 0.0
        return x

    def compare(df, sql):
        found = duck.execute(f"SELECT * FROM ({sql}) q")
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        expected = sorted(repr([plain(x) for x in r]) for r in found.fetchall())
        got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
        assert got == expected

    return compare
