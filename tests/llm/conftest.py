import pytest


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema, with extra columns whose names operators use inside."""

    def make(rows, schema, parts=3):
        extra = ", id long, n long, key string, row string, kept boolean, score double, block int, copies int"
        return spark.createDataFrame([(*r, 1, 2, "k", "r", False, 0.5, 3, 4) for r in rows], schema + extra).repartition(parts)

    return make
