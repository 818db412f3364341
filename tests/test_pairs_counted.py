"""Distinct colleges of a course are counted along an order: no task holds a table of all pairs, no row is expanded."""

import re

from gleaner.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_state_spread_has_no_aggregate_by_college(spark):
    assert not re.search(r"Aggregate\(keys=\[[^\]]*college_id", plan(spark, "G2_state_spread"))


def test_course_enrichment_expands_no_rows(spark):
    assert "Expand" not in plan(spark, "F18_course_enrichment")
