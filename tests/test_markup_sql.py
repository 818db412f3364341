"""The SQL of the queries over elements says what the parser does, also where a reference has no semicolon."""

import duckdb
import pytest

from gleaner.plans import catalogue
from gleaner.plans import markup as _markup  # noqa: F401

PAGE = '<html><head><title>{0}</title></head><body><nav><ul><li><a href="/a">{0}</a></li></ul></nav><article><h1>{0}</h1><div class="ad">{0}</div></article></body></html>'


@pytest.mark.parametrize("name", ["Q_class_inventory", "Q_select_text", "Q_select_links", "Q_select_classes"])
def test_references_without_semicolons(spark, tmp_path, name):
    texts = ["a &amp; b&amp", "&ltb&gt &quotc&quot;", "&amp;lt &amp;amp", "ends in &am"]
    rows = [(i, f"https://h.example/{i}", PAGE.format(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
