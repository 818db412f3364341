"""No stage loses a row or a column that its decision isn't about."""

from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontam, linededup, simhash

LONG = " ".join(f"word{i}" for i in range(60))


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, LONG), (2, LONG), (2, "another text of the same id altogether, with words of its own"), (3, "and a third one that is like nothing else here at all"), (2, LONG.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(simhash.drop_near_copies(df).collect()) == sorted([rows[0], rows[2], rows[3]])
    # the copy of a text whose row has a taken id goes, too
    more = df.union(spark.createDataFrame([(9, rows[2][1])], df.schema))
    assert sorted(simhash.drop_near_copies(more).collect()) == sorted([rows[0], rows[2], rows[3]])


def test_leaks_go_by_text(spark):
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    rows = [(1, LONG), (1, "clean text of the same id"), (None, LONG), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(decontam.drop_contaminated(df, bench).collect(), key=str) == sorted(rows[1:], key=str)


def test_null_and_empty_hosts_are_apart(spark):
    rows = [(i, host, f"menu\nown line {i}") for i, host in enumerate([None] * 4 + [""] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(r.n_dropped_lines for r in linededup.op7_line_dedup(df).collect()) == [0] * 8
    five = df.union(spark.createDataFrame([(9, None, "menu\nown line 9")], df.schema))
    assert sorted((r.source or "-", r.n_dropped_lines) for r in linededup.op7_line_dedup(five).collect()) == sorted([("-", 1)] * 5 + [("-", 0)] * 4)


def test_columns_with_the_stages_own_names_stay(spark):
    rows = [(i, "a", f"menu\nown line {i}", i, i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, N_Dropped_Lines int, line int")
    out = corpus_pipeline.lines(spark, df, "")
    assert out.columns == df.columns and out.where("text like 'menu%'").count() == 0
    assert sorted(r.N_Dropped_Lines for r in out.collect()) == list(range(6))
    assert linededup.drop_boilerplate(df).columns == ["doc_id", "source", "text", "line", "n_dropped_lines"]
