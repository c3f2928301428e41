import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _plain(x):
    import math

    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 5) if isinstance(x, float) else x


@pytest.fixture(scope="session")
def same():
    """Asserts that a frame and SQL over the tables of a folder give the same rows and columns."""

    def check(df, sql, folder):
        import glob

        import duckdb

        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got = [tuple(map(_plain, r)) for r in df.select(sorted(df.columns)).collect()]
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        order = [names.index(c) for c in sorted(df.columns)]
        assert sorted(names) == sorted(df.columns)
        want = [tuple(_plain(r[i]) for i in order) for r in found.fetchall()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert got

    return check
