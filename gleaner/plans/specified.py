"""Registered queries of writes through table specifications, and of reports over tables that may be missing."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators.specs import Phase, Registry, TableSpec
from .catalogue import n, query

NOW = datetime.datetime(2024, 6, 1)
COLLEGES = TableSpec(
    "colleges", ("college_id",), {"college_id": "bigint", "name": "string", "city": "string", "rating": "double", "website": "string", "detail_at": "timestamp", "source_job_id": "bigint", "content_hash": "string", "inactive_since": "timestamp", "first_seen": "timestamp", "last_changed": "timestamp"},
    always=("source_job_id",), phases={"listing": Phase(("name", "city")), "detail": Phase(("rating", "website"), "detail_at")},
)
COURSES = TableSpec("courses", ("course_id",), {"course_id": "bigint", "name": "string", "stream": "string", "source_job_id": "bigint"}, "preserve", always=("source_job_id",))
PROGRESS = TableSpec("progress", ("college_id",), {"college_id": "bigint", "status": "string", "found": "bigint"}, guard="status NOT IN ('done', 'empty')", tracked=False)
ALIASES = TableSpec("aliases", ("slug",), {"slug": "string", "college_id": "bigint"}, "absent", tracked=False)

#: One batch for four tables, made of the directory: some keys come twice, some payloads are broken, none has a rating.
FIELDS = {
    "colleges": ("college_id", "'college_id', college_id, 'name', concat(name, '/', CAST(seq AS STRING)), 'city', CASE WHEN college_id % 7 = 0 THEN NULL ELSE city END, 'source_job_id', college_id % 5"),
    "courses": ("college_id", "'course_id', college_id, 'name', CASE WHEN college_id % 5 = 0 THEN '' ELSE concat('course ', CAST(college_id AS STRING)) END, 'stream', CASE WHEN college_id % 3 = 0 THEN NULL ELSE city END, 'source_job_id', seq"),
    "progress": ("college_id", "'college_id', college_id, 'status', 'queued', 'found', 0"),
    "aliases": ("college_id", "'slug', concat('s', CAST(college_id % 50 AS STRING)), 'college_id', college_id"),
}


def registry(t) -> Registry:
    """The given tables as stored ones; nothing has been written to ``aliases`` yet."""
    stored = {"colleges": t.colleges.select("college_id", "name", "city", "rating"), "courses": t.courses.select("course_id", "name", "stream"), "progress": t.progress.select("college_id", "status", "found")}
    return Registry([COLLEGES, COURSES, PROGRESS, ALIASES], lambda name: stored[name] if name in stored else t.read(f"no_such_{name}"))


def batch(t):
    rows = t.directory.withColumn("seq", F.explode(F.expr("sequence(1, IF(college_id % 4 = 0, 2, 1))")))
    rows = rows.withColumn("one", F.explode(F.array(*(F.struct(F.lit(name).alias("table_name"), F.expr(f"to_json(named_struct({fields}))").alias("payload")) for name, (_, fields) in FIELDS.items()))))
    broken = F.when(F.col("college_id") % 11 == 0, F.concat(F.lit("{"), F.col("one.payload"))).otherwise(F.col("one.payload"))
    return rows.select("seq", F.col("college_id").alias("at"), F.col("one.table_name").alias("table_name"), broken.alias("payload"))


LAST = "d AS (SELECT college_id, name, city, CASE WHEN college_id % 4 = 0 THEN 2 ELSE 1 END AS seq FROM directory WHERE college_id % 11 <> 0)"


@query("J_one_batch_four_policies", f"""WITH {LAST},
 x AS (SELECT 'colleges' AS table_name, CAST(coalesce(c.college_id, d.college_id) AS VARCHAR) AS pk, CASE WHEN d.college_id IS NULL THEN c.name ELSE concat(d.name, '/', CAST(seq AS VARCHAR)) END AS a, CASE WHEN d.college_id IS NULL THEN c.city WHEN d.college_id % 7 = 0 THEN NULL ELSE d.city END AS b, CAST(d.college_id % 5 AS BIGINT) AS job, c.rating FROM colleges c FULL JOIN d ON c.college_id = d.college_id),
 y AS (SELECT 'courses', CAST(coalesce(c.course_id, d.college_id) AS VARCHAR), CASE WHEN d.college_id IS NULL OR d.college_id % 5 = 0 AND c.course_id IS NOT NULL THEN c.name WHEN d.college_id % 5 = 0 THEN '' ELSE concat('course ', CAST(d.college_id AS VARCHAR)) END, CASE WHEN d.college_id IS NULL OR d.college_id % 3 = 0 THEN c.stream ELSE d.city END, CAST(seq AS BIGINT), NULL FROM courses c FULL JOIN d ON c.course_id = d.college_id),
 z AS (SELECT 'progress', CAST(coalesce(p.college_id, d.college_id) AS VARCHAR), CASE WHEN d.college_id IS NULL OR p.status IN ('done', 'empty') THEN p.status ELSE 'queued' END, CAST(CASE WHEN d.college_id IS NULL OR p.status IN ('done', 'empty') THEN p.found ELSE 0 END AS VARCHAR), NULL, NULL FROM progress p FULL JOIN d ON p.college_id = d.college_id),
 w AS (SELECT 'aliases', concat('s', CAST(college_id % 50 AS VARCHAR)), CAST(max(college_id) AS VARCHAR), NULL, NULL, NULL FROM d WHERE seq = 2 OR (college_id % 50) NOT IN (SELECT college_id % 50 FROM d WHERE seq = 2) GROUP BY college_id % 50)
 SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z UNION ALL SELECT * FROM w""")
def four_policies(t):
    """Four tables after one batch of payloads: overwritten, preserved, guarded, and inserted into a table that wasn't there."""
    out = registry(t).write(t.spark, batch(t), ["seq", "at"])
    text = lambda c: F.col(c).cast("string")
    none, nothing = F.lit(None).cast("bigint").alias("job"), F.lit(None).cast("double").alias("rating")
    name = lambda x: F.lit(x).alias("table_name")
    return (
        out["colleges"].select(name("colleges"), text("college_id").alias("pk"), F.col("name").alias("a"), F.col("city").alias("b"), F.col("source_job_id").alias("job"), "rating")
        .union(out["courses"].select(name("courses"), text("course_id"), "name", "stream", "source_job_id", nothing))
        .union(out["progress"].select(name("progress"), text("college_id"), "status", text("found"), none, nothing))
        .union(out["aliases"].select(name("aliases"), "slug", text("college_id"), F.lit(None), none, nothing))
    )


@query("J_phase_keeps_columns", """SELECT coalesce(c.college_id, d.college_id) AS college_id, c.name, c.city, CASE WHEN d.college_id IS NULL THEN c.rating ELSE d.college_id % 10 END AS rating,
 CASE WHEN d.college_id IS NOT NULL THEN d.website END AS website, CASE WHEN d.college_id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' END AS detail_at FROM colleges c FULL JOIN (SELECT * FROM directory WHERE college_id % 2 = 0) d ON c.college_id = d.college_id""")
def phase(t):
    """What the detail phase writes over what the listing has written: its own columns and its stamp, although the rows name others."""
    rows = t.directory.where("college_id % 2 = 0").withColumn("rating", (F.col("college_id") % 10).cast("double"))
    out = COLLEGES.merged(t.colleges.select("college_id", "name", "city", "rating"), rows, "detail", now=F.lit(NOW))
    return out.select("college_id", "name", "city", "rating", "website", "detail_at")


@query("J_phase_first_visit", """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN c.college_id IS NULL OR c.college_id % 3 <> 0 THEN 'new' WHEN c.rating <> d.college_id % 10 THEN 'changed' WHEN c.college_id % 2 = 0 THEN 'changed' ELSE 'same' END AS verdict
 FROM directory d LEFT JOIN colleges c ON c.college_id = d.college_id) GROUP BY verdict""")
def first_visit(t):
    """A row that the detail phase has not stamped is new to it, whatever the listing's hash says."""
    spec = COLLEGES
    own = spec.tracked_columns("detail")
    base = t.colleges.select("college_id", "name", "city", "rating", F.when(F.col("college_id") % 2 == 1, "").otherwise("old").alias("website"), F.when(F.col("college_id") % 3 == 0, F.lit(NOW)).alias("detail_at"))
    before = spec.migrated(base)
    from ..operators.cdc import with_fingerprint

    before = with_fingerprint(before.drop("content_hash"), own)
    after = spec.batch_of(t.directory.select("college_id", (F.col("college_id") % 10).cast("double").alias("rating"), F.lit("").alias("website")), "detail")
    return spec.observed(before, after, NOW, "detail").groupBy("verdict").agg(n())


@query("J13_specified_columns", "SELECT college_id, name, CAST(NULL AS VARCHAR) AS website, CAST(NULL AS VARCHAR) AS detail_at, phone FROM colleges UNION ALL SELECT college_id, name, website, NULL, NULL FROM directory WHERE college_id NOT IN (SELECT college_id FROM colleges)")
def specified_columns(t):
    """Columns that a stored table lacks are added; one that the specification doesn't know stays."""
    stored = COLLEGES.migrated(t.colleges.select("college_id", "name", "phone"))
    new = t.directory.select("college_id", "name", "website").join(t.colleges, "college_id", "left_anti")
    return stored.unionByName(COLLEGES.migrated(new), allowMissingColumns=True).select("college_id", "name", "website", F.col("detail_at").cast("string").alias("detail_at"), "phone")


FIGURES = {
    "colleges": ("colleges", "count(*)"), "colleges_rated": ("colleges", "count_if(rating > 0)"), "colleges_geocoded": ("colleges", "count_if(latitude IS NOT NULL)"),
    "courses": ("courses", "count(*)"), "streams": ("courses", "count(DISTINCT stream)"), "open": ("progress", "count_if(status NOT IN ('done', 'empty'))"), "aliases": ("aliases", "count(*)"), "alias_slugs": ("aliases", "count(DISTINCT slug)"),
}


@query("O11_tolerant_report", """SELECT 'colleges' AS figure, count(*) AS n FROM colleges UNION ALL SELECT 'colleges_rated', count(*) FROM colleges WHERE rating > 0 UNION ALL SELECT 'colleges_geocoded', NULL UNION ALL SELECT 'courses', count(*) FROM courses
 UNION ALL SELECT 'streams', count(DISTINCT stream) FROM courses UNION ALL SELECT 'open', count(*) FROM progress WHERE status NOT IN ('done', 'empty') UNION ALL SELECT 'aliases', NULL UNION ALL SELECT 'alias_slugs', NULL""")
def tolerant(t):
    """Figures of a report; those about a column or a table that isn't there are NULL."""
    return registry(t).report(t.spark, FIGURES)


@query("O11_missing_as_empty", "SELECT c.college_id, c.city, CAST(NULL AS VARCHAR) AS slug, CAST(NULL AS VARCHAR) AS website FROM colleges c")
def missing_as_empty(t):
    """A join with a table that isn't there, on a table that lacks a column: no row is lost."""
    r = registry(t)
    left, right = r.table(t.spark, "colleges"), r.table(t.spark, "aliases")
    return left.join(right, "college_id", "left").select("college_id", "city", "slug", "website")
