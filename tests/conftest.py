import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    """A value that compares the same whichever engine it comes from."""
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "dtype") and getattr(v, "shape", ()) == ():
        v = v.item()
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())


@pytest.fixture(scope="session")
def matches(spark):
    """Assert that a query gives the rows of its SQL over the tables of a folder."""

    def check(query, sql, sf_dir):
        df = query(spark, sf_dir)
        names, want = sql_rows(sf_dir, sql)
        assert sorted(df.columns) == names
        assert rows(df) == want

    return check


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables by name to a folder like those of the test data."""

    def write(**by_name):
        for name, df in by_name.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
