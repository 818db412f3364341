"""Catalogue tables derived from the given ones, by SQL that both engines run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

DERIVED = {
    "courses": "SELECT p_partkey AS course_id, p_name AS name, p_brand AS stream, p_type AS course_type, CASE WHEN p_size <= 15 THEN 'UG' WHEN p_size <= 35 THEN 'PG' ELSE '' END AS level, CAST(p_size AS BIGINT) AS college_count FROM {part}",
    "colleges": "SELECT s_suppkey AS college_id, s_name AS name, n_name AS city, CAST(n_regionkey AS BIGINT) AS state_id, s_acctbal AS rating, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('https://www.site', CAST(s_suppkey - s_suppkey % 2 AS STRING), '.ac.in/home') END AS website, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('+91 98', CAST(10000000 + s_suppkey - s_suppkey % 3 AS STRING)) END AS phone FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
    "offerings": "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS course_id, l_suppkey AS college_id, CAST(floor(l_extendedprice) AS BIGINT) AS fees_amount, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS rating, CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS ranking, CAST(l_orderkey % 50 AS BIGINT) AS source_job_id, l_shipdate AS scraped_at FROM {lineitem}",
    "directory": "SELECT c_custkey AS college_id, replace(c_name, 'Customer', 'Supplier') AS name, n_name AS city, CAST(n_regionkey AS BIGINT) AS state_id, c_mktsegment AS ownership, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('http://site', CAST(c_custkey - c_custkey % 2 AS STRING), '.ac.in') END AS website, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('098', CAST(10000000 + c_custkey - c_custkey % 3 AS STRING)) END AS phone FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "progress": "SELECT o_custkey AS college_id, CASE max(o_orderstatus) WHEN 'F' THEN 'done' WHEN 'O' THEN 'empty' ELSE 'error' END AS status, count(*) AS found, max(o_orderdate) AS updated_at FROM {orders} GROUP BY o_custkey",
    "logs": "SELECT event_id AS id, ts, user_id AS job_id, event_type AS level, value, props FROM {events}",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def prefix(sql: str) -> str:
    """The SQL with the derived tables that it names put before it."""
    import re

    used = [n for n in DERIVED if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS ({DERIVED[n].format(**{b: b for b in BASE})})" for n in used]
    if not parts:
        return sql
    sql = sql.strip()
    return f"WITH {', '.join(parts)}{', ' + sql[5:] if sql[:5].upper() == 'WITH ' else ' ' + sql}"


class Tables:
    """Given tables by name, and the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _derived(self, name: str) -> DataFrame:
        used = {b: self.read(b) for b in BASE if "{" + b + "}" in DERIVED[name]}
        return self.spark.sql(DERIVED[name], **used)

    @cached_property
    def courses(self) -> DataFrame:
        return self._derived("courses")

    @cached_property
    def colleges(self) -> DataFrame:
        return self._derived("colleges")

    @cached_property
    def offerings(self) -> DataFrame:
        return self._derived("offerings")

    @cached_property
    def directory(self) -> DataFrame:
        return self._derived("directory")

    @cached_property
    def progress(self) -> DataFrame:
        return self._derived("progress")

    @cached_property
    def logs(self) -> DataFrame:
        return self._derived("logs")

    @cached_property
    def pages(self) -> DataFrame:
        return self.read("pages")
