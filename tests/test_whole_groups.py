"""Batches and groups of any size."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from gleaner.operators import relational
from gleaner.plans import catalogue


def test_batch_is_the_whole_directory(spark):
    """The incoming batch grows with the directory."""
    directory = spark.range(4_990, 5_010).select(F.col("id").alias("college_id"), F.lit("town").alias("city"))
    assert catalogue.batch(SimpleNamespace(directory=directory)).count() == 20


def test_upper_median_counts_values_first(spark):
    rows = [("a", x) for x in (5, 1, 1, 9)] + [("b", x) for x in (3, None, 2, 7)] + [("c", None), (None, 4), ("d", 8)]
    out = relational.upper_median(spark.createDataFrame(rows, "level string, n int"), "level", "n")
    assert {r.level: r.median for r in out.collect()} == {"a": 5, "b": 3, "c": None, None: 4, "d": 8}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
