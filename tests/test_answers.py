"""How often the queries over chunks work these out; their rows are held against SQL in test_queries."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.plans import all as plans
from vellum.plans import answers

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", ["mode_recall", "ask_prompt", "ask_sources"])
def test_chunks_are_worked_out_three_times(spark, monkeypatch, name):
    """Once for the vectors and twice for the words, whatever the modes and however often the hits are used."""
    seen, made = spark.sparkContext.accumulator(0), answers._chunks

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(answers, "_chunks", lambda *a: made(*a).withColumn("content", counted("content")))
    assert plans.QUERIES[name](spark, SF_DIR).collect()
    assert seen.value <= 3 * made(spark, SF_DIR).count()
