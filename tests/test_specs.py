"""Table specifications: what they refuse, what a writer may touch, and readers of tables that aren't there."""

import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gleaner.operators import merge
from gleaner.operators.specs import Phase, Registry, TableSpec, qualified

COLUMNS = {"id": "bigint", "name": "string", "fee": "double", "seen_at": "timestamp", "job": "bigint"}
NOW = datetime.datetime(2024, 1, 2)


def spec(**more):
    return TableSpec("things", ("id",), COLUMNS, **({"always": ("job",), "phases": {"list": Phase(("name",)), "detail": Phase(("fee",), "seen_at")}} | more))


@pytest.mark.parametrize("bad", [{"policy": "keep"}, {"always": ("nope",)}, {"phases": {"x": Phase(("nope",))}}, {"phases": {"x": Phase((), "nope")}}])
def test_unknown_names_are_refused(bad):
    with pytest.raises(ValueError):
        spec(**bad)


def stored(spark):
    return spark.createDataFrame([(1, "a", 5.0, None, 7), (2, "b", None, NOW, 7)], ", ".join(f"{c} {k}" for c, k in COLUMNS.items()))


def rows_of(df):
    return sorted(((r.id, r.name, r.fee, r.seen_at, r.job) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "policy,want",
    [
        ("overwrite", [(1, None, 6.0, None, 9), (2, "b", None, NOW, 7), (3, "c", None, None, 9)]),
        ("preserve", [(1, "a", 6.0, None, 9), (2, "b", None, NOW, 7), (3, "c", None, None, 9)]),
        ("fill", [(1, "a", 5.0, None, 9), (2, "b", None, NOW, 7), (3, "c", None, None, 9)]),
        ("absent", [(1, "a", 5.0, None, 7), (2, "b", None, NOW, 7), (3, "c", None, None, 9)]),
    ],
)
def test_policies(spark, policy, want):
    batch = spark.createDataFrame([(1, "old", 1.0, 8, 1), (1, None, 6.0, 9, 2), (None, "no key", 1.0, 9, 3), (3, "c", None, 9, 1)], "id long, name string, fee double, job long, seq int")
    assert rows_of(spec(policy=policy).merged(stored(spark), batch, order=["seq"])) == want


def test_a_phase_writes_its_own_columns_only(spark):
    batch = spark.createDataFrame([(1, "other", 8.0, 9), (4, "new", 1.0, 9)], "id long, name string, fee double, job long")
    assert rows_of(spec().merged(stored(spark), batch, "detail", now=F.lit(NOW))) == [(1, "a", 8.0, NOW, 9), (2, "b", None, NOW, 7), (4, None, 1.0, NOW, 9)]
    assert spec().tracked_columns() == ["fee", "name"] and spec().tracked_columns("detail") == ["fee"] and spec(tracked=False).tracked_columns() == []


def test_guards_look_at_the_stored_row(spark):
    assert qualified("name <> 'id of job' AND job IN (1, 2) AND x.job > 1 AND lower(name) = 'a'", COLUMNS) == "t.name <> 'id of job' AND t.job IN (1, 2) AND x.job > 1 AND lower(t.name) = 'a'"
    batch = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    assert [(r.id, r.name) for r in spec(guard="name <> 'a'").merged(stored(spark), batch).orderBy("id").collect()] == [(1, "a"), (2, "y"), (3, "z")]


def test_missing_tables_and_columns(spark, tmp_path):
    stored(spark).drop("fee").write.parquet(str(tmp_path / "things"))
    reg = Registry([spec(), TableSpec("others", ("id",), {"id": "bigint"})], lambda name: spark.read.parquet(str(tmp_path / name)))
    assert reg.found("others") is None and reg.table(spark, "others").count() == 0
    assert reg.table(spark, "things").columns == list(COLUMNS) and reg.table(spark, "things").where("fee is null").count() == 2
    got = {r.figure: r.n for r in reg.report(spark, {"a": ("things", "count(*)"), "b": ("things", "sum(fee)"), "c": ("others", "count(*)")}).collect()}
    assert got == {"a": 2, "b": None, "c": None}
    with pytest.raises(AnalysisException):  # a figure that is wrong is no missing column
        reg.report(spark, {"a": ("things", "count(*) + nofunction(1)")}).collect()


def test_payloads_of_a_batch(spark):
    reg = Registry([spec(), TableSpec("others", ("id",), {"id": "bigint", "n": "bigint"}, "absent")], lambda name: stored(spark) if name == "things" else spark.read.parquet("/no/such/table"))
    batch = spark.createDataFrame([("things", '{"id": 1, "name": "x"}', 1), ("things", '{"id": 1, "name": "y"}', 2), ("things", '{"id": 2', 3), ("others", '{"id": 5, "n": 1}', 4), ("others", "null", 5), ("elsewhere", '{"id": 9}', 6)], "table_name string, payload string, seq int")
    out = reg.write(spark, batch, ["seq"])
    assert rows_of(out["things"]) == [(1, "y", 5.0, None, 7), (2, "b", None, NOW, 7)]  # no payload names a fee: it stays
    assert [tuple(r) for r in out["others"].collect()] == [(5, 1)]
    assert [(r.pk, r.seq) for r in spec().staged(spark.createDataFrame([("things", 1, 1, 1), ("things", 1, 2, 1), ("others", 1, 3, 1)], "table_name string, id long, seq int, job_id int"), ["seq"]).collect()] == [("1", 2)]


def test_upsert_takes_one_row_a_key(spark):
    target = spark.createDataFrame([(1, "a")], "id long, name string")
    batch = spark.createDataFrame([(1, "b"), (1, "c"), (None, "d"), (2, "e"), (2, "e")], "id long, name string")
    assert sorted(map(tuple, merge.upsert(target, batch, ["id"]).collect())) == [(1, "c"), (2, "e")]
    assert sorted(map(tuple, merge.insert_if_absent(target, batch, ["id"]).collect())) == [(1, "a"), (2, "e")]
