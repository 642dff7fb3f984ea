import pytest

from tidemark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of named values."""

    def evaluate(expression, schema="x string", *values):
        row = values or (None,)
        return spark.createDataFrame([tuple(row)], schema).select(expression).first()[0]

    return evaluate
