import pytest

from mnemospark.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, tuple...) -> DataFrame"""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
