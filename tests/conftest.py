import os
import sys

import pytest

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g pyspark-shell")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from civicledger.session import build_session

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows of dicts or tuples as a DataFrame with a declared schema; ISO texts become dates."""
    from pyspark.sql import functions as F

    def build(schema, *rows):
        fields = [f.strip().split(" ", 1) for f in schema.split(",")]
        texts = ", ".join(f"{n} {'string' if t == 'date' else t}" for n, t in fields)
        df = spark.createDataFrame(list(rows), texts)
        return df.withColumns({n: F.to_date(n) for n, t in fields if t == "date"}) if any(t == "date" for _, t in fields) else df

    return build
