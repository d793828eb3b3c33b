import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pandas as pd
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _one(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        return str(int(v)) if float(v).is_integer() else f"{float(v):.6g}"  # a column with nulls has its integers as floats
    return str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(_one(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def of(**tables):
        c = duckdb.connect()
        for n in TABLES:
            if n not in tables:
                c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
        for n, frame in tables.items():
            c.register(f"_{n}", frame)
            c.execute(f"CREATE VIEW {n} AS SELECT * FROM _{n}")
        return c

    return of
