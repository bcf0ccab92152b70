import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows_of(frame, columns):
    """Sorted rows as text; nulls are empty, whole floats (columns with nulls) are integers."""
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return (str(int(v)) if v.is_integer() else repr(float(v))) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, row)) for row in frame[columns].itertuples(index=False))


def duck(sf="sf0.001"):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(f"{DATA}/{sf}"):
        path = f"{DATA}/{sf}/{name}"
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c
