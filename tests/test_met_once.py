"""What a write means for each row takes one join, and neither side goes through the driver."""

from gleaner.plans import catalogue


def test_two_states_meet_once_by_a_shuffle(spark):
    for name in ("L4_observe", "L6_counters", "L6_reconcile"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("SortMergeJoin"), plan.count("Broadcast")) == (1, 0), name
