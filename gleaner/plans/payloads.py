"""Registered queries on record payloads: projections, child rows, shapes, and the refresh plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as V
from ..functions import text as X
from .catalogue import n, query


def records(t):
    """(id, v): one JSON record for each offering, as a harvester finds it."""
    body = F.struct(
        F.concat(F.lit("Offering "), F.col("id")).alias("name"),
        F.struct("college_id", F.lit("").alias("city")).alias("college"),
        F.struct(F.col("fees_amount").alias("amount"), F.concat(F.lit("₹ "), F.col("fees_amount")).alias("text")).alias("fees_data"),
        F.when(F.col("rating") > 0, F.col("rating").cast("int")).alias("rating"),
    )
    return t.offerings.select("id", F.try_parse_json(F.to_json(body)).alias("v"))


@query("C1_offering_records", """SELECT id, concat('Offering ', id) AS name, college_id, fees_amount, fees_amount AS fees_of_text, CASE WHEN rating > 0 THEN CAST(rating AS DOUBLE) END AS rating FROM offerings""")
def offering_records(t):
    v = F.col("v")
    return records(t).select(
        "id", V.first_text(v, "$.title", "$.name").alias("name"), V.field(v, "$.college.college_id", "bigint").alias("college_id"),
        V.field(v, "$.fees_data.amount", "bigint").alias("fees_amount"), X.fee_to_units(V.first_text(v, "$.fees_data.text")).alias("fees_of_text"),
        V.field(v, "$.rating", "double").alias("rating"),
    )


@query("H24_first_text", """SELECT college_id, coalesce(nullif(website, ''), nullif(phone, ''), city) AS contact FROM colleges""")
def first_text(t):
    record = F.try_parse_json(F.to_json(F.struct("website", "phone", F.struct("city").alias("place"))))
    return t.colleges.select("college_id", V.first_text(record, "$.website", "$.phone", "$.place.city").alias("contact"))


@query("H25_label_block", """SELECT course_id, course_type, nullif(level, '') AS level FROM courses""")
def label_block(t):
    entry = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).alias("value"))
    block = F.array(entry("Level ", "level"), entry("Stream", "stream"), entry("COURSE TYPE", "course_type"))
    return t.courses.select("course_id", *V.label_block(block, {"course type": "course_type", "level": "level"}))


@query("H26_ordered_steps", """SELECT course_id, concat(stream, ' > ', course_type, ' > ', name) AS steps FROM courses""")
def ordered_steps(t):
    steps = F.create_map(F.lit("10"), F.col("name"), F.lit("2"), F.col("course_type"), F.lit("1"), F.col("stream"))
    return t.courses.select("course_id", F.array_join(V.ordered_steps(steps), " > ").alias("steps"))


@query("I1_child_rows", r"""SELECT page_id, CAST(i AS INTEGER) - 1 AS pos, l[i] AS link FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1) AS l FROM pages))""")
def child_rows(t):
    """A row for each link of a page, with its place."""
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?i)<a href="([^"]*)"'), F.lit(1))).alias("pos", "link"))


@query("I2_specialisations", """SELECT course_id, CASE WHEN lower(stream) = 'brand#1' THEN name ELSE concat(name, ' (', stream, ')') END AS title FROM (SELECT *, row_number() OVER (PARTITION BY lower(CASE WHEN lower(stream) = 'brand#1' THEN name ELSE concat(name, ' (', stream, ')') END) ORDER BY course_id) AS r FROM courses) WHERE r = 1""")
def specialisations(t):
    """Course and specialisation as one title, each title once; the general one adds nothing."""
    title = F.when(F.lower("stream") == "brand#1", F.col("name")).otherwise(F.concat("name", F.lit(" ("), "stream", F.lit(")")))
    titled = t.courses.select("course_id", title.alias("title"))
    return titled.groupBy(F.lower("title").alias("k")).agg(F.min_by(F.struct("course_id", "title"), "course_id").alias("x")).select("x.course_id", "x.title")


@query("I3_edges_and_catalogue", """SELECT course_id, count(DISTINCT college_id) AS n_colleges, count(*) AS n_tuples FROM offerings GROUP BY course_id""")
def edges_and_catalogue(t):
    """The catalogue of courses from distinct (college, course) edges; each edge carries its repeats."""
    edges = t.offerings.groupBy("course_id", "college_id").agg(n())
    return edges.groupBy("course_id").agg(n("n_colleges"), F.sum("n").alias("n_tuples"))


@query("I5_shape_dump", """SELECT 'name' AS path, 'text' AS kind, count(*) AS n FROM offerings UNION ALL SELECT 'college', 'object', count(*) FROM offerings UNION ALL SELECT 'fees_data', 'object', count(*) FROM offerings UNION ALL SELECT 'rating', 'number', count(*) FROM offerings WHERE rating > 0""")
def shape_dump(t):
    return V.nodes(records(t), depth=1).groupBy("path", "kind").agg(n())


@query("I6_schema_tree", """SELECT path, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT 'name' AS path, length(concat('Offering ', id)) + 2 AS bytes FROM offerings
 UNION ALL SELECT 'college', length(concat('{"city":"","college_id":', college_id, '}')) FROM offerings UNION ALL SELECT 'college.college_id', length(CAST(college_id AS VARCHAR)) FROM offerings UNION ALL SELECT 'college.city', 2 FROM offerings
 UNION ALL SELECT 'fees_data', strlen(concat('{"amount":', fees_amount, ',"text":"₹ ', fees_amount, '"}')) FROM offerings UNION ALL SELECT 'fees_data.amount', length(CAST(fees_amount AS VARCHAR)) FROM offerings UNION ALL SELECT 'fees_data.text', strlen(concat('"₹ ', fees_amount, '"')) FROM offerings
 UNION ALL SELECT 'rating', length(CAST(CAST(rating AS INTEGER) AS VARCHAR)) FROM offerings WHERE rating > 0) GROUP BY path""")
def schema_tree(t):
    """Records and bytes at each path."""
    return V.nodes(records(t), depth=2).groupBy("path").agg(n(), F.sum("bytes").alias("bytes"))


@query("L17_refresh_plan", """SELECT source_job_id, count(*) AS total, count(*) FILTER (WHERE scraped_at < cut) AS stale, CASE WHEN 2 * count(*) FILTER (WHERE scraped_at < cut) >= count(*) THEN 'sweep' WHEN count(*) FILTER (WHERE scraped_at < cut) > 0 THEN 'rows' ELSE 'none' END AS plan
 FROM offerings, (SELECT max(scraped_at) - INTERVAL 1000 DAY AS cut FROM offerings) GROUP BY source_job_id""")
def refresh_plan(t):
    """What to harvest again: a whole partition where half of its rows are old, else the old rows."""
    cut = t.offerings.agg((F.max("scraped_at") - F.expr("INTERVAL 1000 DAY")).alias("cut"))  # one row
    o = t.offerings.join(F.broadcast(cut)).groupBy("source_job_id").agg(n("total"), F.count_if(F.col("scraped_at") < F.col("cut")).alias("stale"))
    return o.withColumn("plan", F.when(2 * F.col("stale") >= F.col("total"), "sweep").when(F.col("stale") > 0, "rows").otherwise("none"))


@query("N15_facet_countries", """WITH f AS (SELECT facet, count(*) AS n FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN replace(lower(n_name), '_', ' ') WHEN 2 THEN n_name ELSE 'Elsewhere' END AS facet FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY facet)
 SELECT facet, f.n, coalesce(a.n_nationkey, b.n_nationkey) AS code, CASE WHEN a.n_nationkey IS NOT NULL THEN 'exact' WHEN b.n_nationkey IS NOT NULL THEN 'folded' ELSE 'none' END AS stage
 FROM f LEFT JOIN nation a ON a.n_name = facet LEFT JOIN nation b ON regexp_replace(lower(b.n_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(facet), '[^a-z0-9]', '', 'g')""")
def facet_countries(t):
    """Facet labels to country codes: the exact name first, then the name without case and signs."""
    key = F.col("c_custkey") % 4
    label = F.when(key.isin(0, 2), F.col("n_name")).when(key == 1, F.replace(F.lower("n_name"), F.lit("_"), F.lit(" "))).otherwise("Elsewhere")
    nation, fold = t.read("nation"), lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    facets = t.read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(label.alias("facet")).agg(n())
    exact = nation.select(F.col("n_name").alias("facet"), F.col("n_nationkey").alias("exact"))
    folded = nation.groupBy(fold("n_name").alias("k")).agg(F.min("n_nationkey").alias("folded"))
    stage = F.when(F.col("exact").isNotNull(), "exact").when(F.col("folded").isNotNull(), "folded").otherwise("none")
    found = facets.join(exact, "facet", "left").withColumn("k", fold("facet")).join(folded, "k", "left")
    return found.select("facet", "n", F.coalesce("exact", "folded").alias("code"), stage.alias("stage"))
