import pytest
from llm_data import ODD, SCHEMA, rows_of


@pytest.fixture(scope="session")
def documents(spark):
    """Pairs of id and text as documents, with more columns whose names the operators use themselves."""
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)


@pytest.fixture(scope="session")
def odd():
    return list(enumerate(ODD))
