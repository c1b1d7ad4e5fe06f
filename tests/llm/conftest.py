import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a schema as a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
