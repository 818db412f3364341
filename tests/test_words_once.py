"""Names are read, and their words looked for, once: the steps of a match by name share what was made of them."""

from gleaner.operators import linkage
from gleaner.plans import catalogue, linking  # noqa: F401  registers its queries


def test_matches_by_name_read_their_tables_once(spark):
    for name in ("N7_blocked_best_match", "N8_merged_evidence", "N13_overlap"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        most = 1 if name.startswith("N7") else 0  # there the left ids are looked up by name at the end
        assert plan.count("FileScan parquet [s_suppkey") <= most, name
        assert "FileScan parquet [c_custkey" not in plan and "FileScan parquet [p_partkey" not in plan, name


def test_repeated_and_absent_names(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, name string")
    left = df([(1, "alpha beta"), (2, "alpha beta"), (3, "Beta, Alpha"), (4, None), (5, ""), (6, "7")])
    right = df([(30, "alpha beta"), (20, "ALPHA beta"), (25, "alpha beta"), (1, None), (2, "9")])
    got = {r.l_id: (r.r_id, r.score) for r in linkage.best_by_name(left, right).collect()}
    assert got == {1: (20, 1.0), 2: (20, 1.0), 3: (20, 1.0)}
    sides = {r.side: (r.n, r.n_strict) for r in linkage.overlap(left, right).collect()}
    assert sides == {"left": (6, 3), "right": (5, 3), "left-self": (6, 3), "right-self": (5, 3)}
