import pytest

from tallyhire.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "4")


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal inputs: one(fn, value, ...) -> Python value."""
    from pyspark.sql import functions as F

    row = spark.range(1)

    def run(fn, *args, types=None):
        types = types or ["string"] * len(args)
        cols = [F.lit(a).cast(t) for a, t in zip(args, types)]
        return row.select(fn(*cols).alias("v")).first()["v"]

    return run
