"""The registered catalogue queries: each a DataFrame plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cdc, merge
from ..operators import relational as R
from ..sources import pages as P
from ..sources import sinks
from ..streaming import promote as S
from .tables import Tables, prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = prefix(sql)
        return f

    return register


def n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# ---- scans, planning and sinks (A, B) ----


@query("A3_sparse_tail_pages", """SELECT job_id, count(*) AS pages_read FROM (SELECT *, sum(g) OVER (PARTITION BY job_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS gaps FROM
 (SELECT job_id, page, CASE WHEN page - lag(page, 1, 0) OVER (PARTITION BY job_id ORDER BY page) > 6 THEN 1 ELSE 0 END AS g FROM (SELECT DISTINCT job_id, CAST(floor(value / 10) AS BIGINT) AS page FROM logs WHERE value < 4000))) WHERE gaps = 0 GROUP BY job_id""")
def sparse_tail(t):
    """Pages with rows, up to the first run of more than five empty ones, and 400 at most."""
    w = Window.partitionBy("job_id").orderBy("page")
    pages = t.logs.select("job_id", F.floor(F.col("value") / 10).cast("long").alias("page")).where("page < 400").distinct()
    gap = F.when(F.col("page") - F.lag("page", 1, 0).over(w) > 6, 1).otherwise(0)
    return pages.withColumn("g", gap).withColumn("gaps", F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("gaps = 0").groupBy("job_id").agg(n("pages_read"))


@query("A4_partition_plan", """WITH r AS (SELECT stream, course_type, level, count(*) AS n, grouping(course_type) + grouping(level) AS open FROM courses GROUP BY ROLLUP (stream, course_type, level) HAVING grouping(stream) = 0)
 SELECT a.stream, a.course_type, a.level, a.n FROM r a WHERE (a.n <= 40 OR a.open = 0) AND NOT EXISTS (SELECT 1 FROM r b WHERE b.open > a.open AND b.n <= 40 AND b.stream = a.stream AND (b.open = 2 OR b.course_type = a.course_type))""")
def partition_plan(t):
    """Slices of at most 40 rows, split by the next column only where they are larger."""
    r = t.courses.rollup("stream", "course_type", "level").agg(n(), (F.grouping("course_type") + F.grouping("level")).alias("open"), F.grouping("stream").alias("all")).where("all = 0")
    w = lambda *c: Window.partitionBy(*c)
    small_2 = F.max((F.col("open") == 2) & (F.col("n") <= 40)).over(w("stream"))
    small_1 = F.max((F.col("open") == 1) & (F.col("n") <= 40)).over(w("stream", "course_type"))
    keep = F.when(F.col("open") == 2, F.col("n") <= 40).when(F.col("open") == 1, (F.col("n") <= 40) & ~small_2).otherwise(~small_1 & ~small_2)
    return r.withColumn("keep", keep).where("keep").select("stream", "course_type", "level", "n")


@query("A5_facet_partitions", """SELECT dim, value, count(*) AS n FROM (SELECT 'stream' AS dim, stream AS value FROM courses UNION ALL SELECT 'course_type', course_type FROM courses UNION ALL SELECT 'level', level FROM courses)
 WHERE concat(dim, '=', value) NOT IN ('level=UG', 'course_type=ECONOMY') GROUP BY dim, value""")
def facets(t):
    """Slices by each facet; those already done are not dealt again."""
    f = t.courses.unpivot([], ["stream", "course_type", "level"], "dim", "value").groupBy("dim", "value").agg(n())
    done = t.spark.createDataFrame([("level=UG",), ("course_type=ECONOMY",)], "k string")
    return f.join(done, F.concat("dim", F.lit("="), "value") == F.col("k"), "left_anti")


@query("A10_page_titles", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages""")
def page_titles(t):
    return t.pages.select("page_id", P.title(F.col("html")).alias("title"), F.size(P.links(F.col("html"))).cast("long").alias("n_links"))


@query("A13_links_exploded", r"""SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY link""")
def links_exploded(t):
    return t.pages.select(F.explode(P.links(F.col("html"))).alias("link")).groupBy("link").agg(n())


@query("A11_script_state", r"""SELECT page_id, nullif(regexp_extract(html, '<style>p(\{[^{}]*\})', 1), '') AS state FROM pages""")
def script_state(t):
    """The rule block of each page's style element, by balanced braces."""
    return P.script_state(t.pages.select("page_id", "html"), "html", "<style>p").select("page_id", "state")


@query("A18_facet_counts", """SELECT 'stream' AS facet, stream AS value_id, count(*) AS n FROM courses GROUP BY stream UNION ALL SELECT 'level', level, count(*) FROM courses GROUP BY level""")
def facet_counts(t):
    return t.courses.unpivot([], ["stream", "level"], "facet", "value_id").groupBy("facet", "value_id").agg(n())


@query("B5_master_sheet", """SELECT o.id, o.course_id, o.college_id, o.fees_amount, c.name, c.city FROM offerings o LEFT JOIN colleges c USING (college_id)""")
def master_sheet(t):
    return t.offerings.join(t.colleges, "college_id", "left").select("id", "course_id", "college_id", "fees_amount", "name", "city")


@query("B7_cells_as_text", """SELECT CAST(college_id AS STRING) AS college_id, coalesce(name, '') AS name, coalesce(website, '') AS website FROM colleges""")
def cells(t):
    return sinks.for_export(t.colleges.select("college_id", "name", "city", "website"), heavy=["city"])


@query("B8_export_size", """SELECT count(*) AS n_rows, CAST(sum(length(CAST(course_id AS STRING)) + length(name) + length(stream) + length(course_type) + length(level) + 5) AS BIGINT) AS n_bytes FROM courses""")
def export_size(t):
    return sinks.size_estimate(t.courses.drop("college_count"))


@query("B11_job_extract", """SELECT id, course_id, college_id FROM offerings WHERE source_job_id = 7""")
def job_extract(t):
    return t.offerings.where("source_job_id = 7").select("id", "course_id", "college_id")


# ---- filters (C) ----


@query("C6_query_builder", """SELECT id, course_id, fees_amount FROM offerings JOIN courses USING (course_id) WHERE name ILIKE '%widget%' AND fees_amount > 0 AND fees_amount <= 40000 AND rating >= 10 AND level IN ('UG', 'PG') ORDER BY id LIMIT 1000""")
def query_builder(t):
    wanted = [F.col("name").ilike("%widget%"), (F.col("fees_amount") > 0) & (F.col("fees_amount") <= 40_000), F.col("rating") >= 10, F.col("level").isin("UG", "PG")]
    df = t.offerings.join(t.courses, "course_id")
    for w in wanted:
        df = df.where(w)
    return df.select("id", "course_id", "fees_amount").orderBy("id").limit(1000)


@query("C7_unified_search", """SELECT * FROM (SELECT 'college' AS kind, college_id AS id, name FROM colleges WHERE name ILIKE '%00%7%' OR city ILIKE '%i%' UNION ALL SELECT 'directory', college_id, name FROM directory WHERE name ILIKE '%00%7%' OR city ILIKE '%i%') ORDER BY kind, id LIMIT 500""")
def unified_search(t):
    hit = F.col("name").ilike("%00%7%") | F.col("city").ilike("%i%")
    one = lambda df, kind: df.where(hit).select(F.lit(kind).alias("kind"), F.col("college_id").alias("id"), "name")
    return one(t.colleges, "college").unionByName(one(t.directory, "directory")).orderBy("kind", "id").limit(500)


@query("C11_missing_website", """SELECT college_id FROM colleges WHERE website IS NULL OR website = ''""")
def missing_website(t):
    return t.colleges.where(X.missing(F.col("website"))).select("college_id")


@query("C12_junk_rows", """SELECT course_id, name FROM courses WHERE name ILIKE '%fee%' OR name ILIKE '%cold%' OR substring(name, 1, 1) IN ('1', '2', '3') OR lower(trim(name)) IN ('red widget', 'small widget')""")
def junk(t):
    c = F.col("name")
    return t.courses.where(c.ilike("%fee%") | c.ilike("%cold%") | F.substring(c, 1, 1).isin("1", "2", "3") | F.lower(F.trim(c)).isin("red widget", "small widget")).select("course_id", "name")


@query("C13_page_kind", r"""SELECT CASE WHEN contains(url, '/es/') THEN 'spanish' WHEN contains(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/(de|fr)/') THEN 'other' ELSE 'none' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def page_kind(t):
    u = F.col("url")
    kind = F.when(F.contains(u, F.lit("/es/")), "spanish").when(F.contains(u, F.lit("/en/")), "english").when(u.rlike("/(de|fr)/"), "other").otherwise("none")
    return t.pages.groupBy(kind.alias("kind")).agg(n())


@query("C14_url_parts", r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS section, TRY_CAST(regexp_extract(url, '/([0-9]+)[^/0-9]*', 1) AS BIGINT) AS item FROM pages""")
def url_parts(t):
    item = F.regexp_extract("url", "/([0-9]+)[^/0-9]*", 1)
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1).alias("section"), item.try_cast("long").alias("item"))


@query("C17_whole_keys", """SELECT college_id, website FROM colleges WHERE college_id IS NOT NULL AND website IS NOT NULL""")
def whole_keys(t):
    return t.colleges.select("college_id", "website").dropna(subset=["college_id", "website"])


# ---- joins and sets (D, E) ----


@query("D2_offerings_with_courses", """SELECT stream, count(*) AS n, count(DISTINCT college_id) AS colleges FROM offerings JOIN courses USING (course_id) GROUP BY stream""")
def d2(t):
    return t.offerings.join(t.courses, "course_id").groupBy("stream").agg(n(), F.countDistinct("college_id").alias("colleges"))


@query("D3_directory_gap", """SELECT d.college_id, d.name FROM directory d LEFT JOIN colleges c ON d.college_id = c.college_id WHERE c.college_id IS NULL""")
def d3(t):
    return t.directory.join(t.colleges, "college_id", "left_anti").select("college_id", "name")


@query("D4_college_gap", """SELECT course_id FROM courses WHERE NOT EXISTS (SELECT 1 FROM offerings o WHERE o.course_id = courses.course_id AND o.fees_amount > 60000)""")
def d4(t):
    return t.courses.join(t.offerings.where("fees_amount > 60000"), "course_id", "left_anti").select("course_id")


@query("D5_overlap_by_state", """SELECT d.state_id, count(*) AS total, CAST(sum(CASE WHEN c.college_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS covered FROM directory d LEFT JOIN colleges c ON d.college_id = c.college_id GROUP BY d.state_id""")
def d5(t):
    known = t.colleges.select("college_id", F.lit(True).alias("known"))
    return t.directory.join(known, "college_id", "left").groupBy("state_id").agg(n("total"), F.count_if("known").alias("covered"))


@query("D8_queue", """SELECT d.college_id FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id WHERE p.status IS NULL OR p.status NOT IN ('done', 'empty')""")
def d8(t):
    return R.pending(t.directory, t.progress, "college_id").select("college_id")


@query("D9_three_way_queue", """SELECT c.college_id FROM colleges c JOIN progress p ON p.college_id = c.college_id AND p.status = 'empty' LEFT JOIN (SELECT DISTINCT college_id FROM offerings WHERE fees_amount > 90000) o ON o.college_id = c.college_id WHERE o.college_id IS NULL""")
def d9(t):
    return t.colleges.join(t.progress.where("status = 'empty'").select("college_id"), "college_id").join(t.offerings.where("fees_amount > 90000"), "college_id", "left_anti").select("college_id")


@query("D11_exists", """SELECT college_id FROM colleges c WHERE EXISTS (SELECT 1 FROM offerings o WHERE o.college_id = c.college_id AND o.ranking > 45)""")
def d11(t):
    return t.colleges.join(t.offerings.where("ranking > 45"), "college_id", "left_semi").select("college_id")


@query("D12_not_in", """SELECT college_id FROM directory WHERE college_id NOT IN (SELECT college_id FROM progress WHERE status = 'error' AND college_id IS NOT NULL)""")
def d12(t):
    return t.directory.join(t.progress.where("status = 'error' AND college_id IS NOT NULL"), "college_id", "left_anti").select("college_id")


@query("D14_counts_by_folded_key", """SELECT c.city, coalesce(n, 0) AS n FROM (SELECT DISTINCT city FROM colleges) c LEFT JOIN (SELECT lower(city) AS k, count(*) AS n FROM directory GROUP BY 1) d ON lower(c.city) = d.k""")
def d14(t):
    d = t.directory.groupBy(F.lower("city").alias("k")).agg(n())
    return t.colleges.select("city").distinct().join(d, F.lower("city") == F.col("k"), "left").select("city", F.coalesce("n", F.lit(0)).alias("n"))


@query("D18_name_lookup", """SELECT p.college_id, coalesce(nullif(c.name, ''), nullif(d.name, ''), '?') AS name FROM progress p LEFT JOIN colleges c ON c.college_id = p.college_id LEFT JOIN directory d ON d.college_id = p.college_id""")
def d18(t):
    c, d = t.colleges.select("college_id", F.col("name").alias("a")), t.directory.select("college_id", F.col("name").alias("b"))
    name = F.coalesce(X.nonempty(F.col("a")), X.nonempty(F.col("b")), F.lit("?"))
    return t.progress.join(c, "college_id", "left").join(d, "college_id", "left").select("college_id", name.alias("name"))


@query("D19_merged_inventory", """SELECT coalesce(c.college_id, d.college_id) AS college_id, CASE WHEN length(coalesce(c.name, '')) >= length(coalesce(d.name, '')) THEN c.name ELSE d.name END AS name, coalesce(nullif(c.website, ''), nullif(d.website, '')) AS website FROM colleges c FULL OUTER JOIN directory d ON c.college_id = d.college_id""")
def d19(t):
    c = t.colleges.select("college_id", F.col("name").alias("cn"), F.col("website").alias("cw"))
    d = t.directory.select("college_id", F.col("name").alias("dn"), F.col("website").alias("dw"))
    size = lambda x: F.length(F.coalesce(x, F.lit("")))
    return c.join(d, "college_id", "full_outer").select("college_id", F.when(size("cn") >= size("dn"), F.col("cn")).otherwise(F.col("dn")).alias("name"), F.coalesce(X.nonempty(F.col("cw")), X.nonempty(F.col("dw"))).alias("website"))


@query("E1_cross_source", """WITH a AS (SELECT DISTINCT college_id FROM directory), b AS (SELECT DISTINCT college_id FROM colleges)
 SELECT count(a.college_id) AS n_a, count(b.college_id) AS n_b, CAST(count(*) FILTER (WHERE a.college_id IS NOT NULL AND b.college_id IS NOT NULL) AS BIGINT) AS n_both, count(*) FILTER (WHERE b.college_id IS NULL) AS only_a, count(*) FILTER (WHERE a.college_id IS NULL) AS only_b, count(*) AS n_union FROM a FULL OUTER JOIN b ON a.college_id = b.college_id""")
def e1(t):
    return R.cross_source(t.directory, t.colleges, "college_id")


@query("E3_grow_only_union", """SELECT college_id, array_to_string(list_sort(list_distinct(list(level))), ',') AS levels, max(scraped_at) AS newest FROM offerings JOIN courses USING (course_id) GROUP BY college_id""")
def e3(t):
    return t.offerings.join(t.courses, "course_id").groupBy("college_id").agg(F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels"), F.max("scraped_at").alias("newest"))


@query("E4_worklist", """SELECT DISTINCT course_id FROM courses WHERE course_id IN (SELECT course_id FROM offerings WHERE rating > 0) AND course_id NOT IN (SELECT course_id FROM offerings WHERE source_job_id = 3 AND course_id IS NOT NULL)""")
def e4(t):
    return t.courses.join(t.offerings.where("rating > 0"), "course_id", "left_semi").join(t.offerings.where("source_job_id = 3"), "course_id", "left_anti").select("course_id").distinct()


# ---- aggregates (F) ----


@query("F1_courses_by_stream", """SELECT stream, count(*) AS n, CAST(sum(college_count) AS BIGINT) AS colleges FROM courses GROUP BY stream""")
def f1(t):
    return t.courses.groupBy("stream").agg(n(), F.sum("college_count").alias("colleges"))


@query("F2_by_type_and_level", """SELECT course_type, level, count(*) AS n FROM courses GROUP BY course_type, level""")
def f2(t):
    return t.courses.groupBy("course_type", "level").agg(n())


@query("F3_by_city", """SELECT city, count(DISTINCT c.college_id) AS colleges, count(*) AS n FROM offerings o JOIN colleges c USING (college_id) GROUP BY city""")
def f3(t):
    return t.offerings.join(t.colleges, "college_id").groupBy("city").agg(F.countDistinct("college_id").alias("colleges"), n())


@query("F4_fee_by_stream", """SELECT stream, count(*) AS n, round(avg(nullif(fees_amount, 0)), 0) AS avg_fee FROM offerings JOIN courses USING (course_id) GROUP BY stream""")
def f4(t):
    return t.offerings.join(t.courses, "course_id").groupBy("stream").agg(n(), F.round(F.avg(X.nonzero(F.col("fees_amount"))), 0).alias("avg_fee"))


@query("F5_group_count", """SELECT level, count(*) AS n FROM courses WHERE level IS NOT NULL AND level <> '' GROUP BY level""")
def f5(t):
    return t.courses.where(~X.missing(F.col("level"))).groupBy("level").agg(n())


@query("F6_top_cities", """SELECT city, count(DISTINCT college_id) AS n FROM directory GROUP BY city ORDER BY n DESC, city LIMIT 10""")
def f6(t):
    return t.directory.groupBy("city").agg(F.countDistinct("college_id").alias("n")).orderBy(F.desc("n"), "city").limit(10)


FEES = ((5_000, "under 5k"), (10_000, "5k-10k"), (20_000, "10k-20k"), (40_000, "20k-40k"), (60_000, "40k-60k"), (80_000, "60k-80k"), (None, "80k and more"))


@query("F7_fee_histogram", """SELECT CASE WHEN fees_amount < 5000 THEN 'under 5k' WHEN fees_amount < 10000 THEN '5k-10k' WHEN fees_amount < 20000 THEN '10k-20k' WHEN fees_amount < 40000 THEN '20k-40k' WHEN fees_amount < 60000 THEN '40k-60k' WHEN fees_amount < 80000 THEN '60k-80k' ELSE '80k and more' END AS bucket, count(*) AS n, min(fees_amount) AS lowest FROM offerings WHERE fees_amount IS NOT NULL GROUP BY 1""")
def f7(t):
    return R.histogram(t.offerings, F.col("fees_amount"), FEES)


@query("F9_rating_histogram", """SELECT CASE WHEN rating < 10 THEN 'low' WHEN rating < 25 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, min(rating) AS lowest FROM offerings WHERE rating IS NOT NULL GROUP BY 1""")
def f9(t):
    return R.histogram(t.offerings, F.col("rating"), ((10, "low"), (25, "mid"), (None, "high")))


@query("F12_coverage_by_stream", """SELECT stream, count(*) AS total, CAST(sum(CASE WHEN o.course_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS done, round(100.0 * sum(CASE WHEN o.course_id IS NOT NULL THEN 1 ELSE 0 END) / count(*), 1) AS percent FROM courses c LEFT JOIN (SELECT DISTINCT course_id FROM offerings WHERE fees_amount > 70000) o ON c.course_id = o.course_id GROUP BY stream""")
def f12(t):
    done = t.offerings.where("fees_amount > 70000").select("course_id").distinct().withColumn("ok", F.lit(True))
    g = t.courses.join(done, "course_id", "left").groupBy("stream").agg(n("total"), F.count_if("ok").alias("done"))
    return g.withColumn("percent", F.round(100.0 * F.col("done") / F.col("total"), 1))


@query("F13_summary", """SELECT count(*) AS n, count(DISTINCT college_id) AS colleges, count(DISTINCT course_id) AS courses_seen, count(*) FILTER (WHERE fees_amount > 0) AS with_fee, count(*) FILTER (WHERE rating > 0) AS rated FROM offerings""")
def f13(t):
    return t.offerings.agg(n(), F.countDistinct("college_id").alias("colleges"), F.countDistinct("course_id").alias("courses_seen"), F.count_if(F.col("fees_amount") > 0).alias("with_fee"), F.count_if(F.col("rating") > 0).alias("rated"))


@query("F14_normalised_label", """SELECT coalesce(nullif(trim(level), ''), '-') AS label, count(*) AS n FROM courses GROUP BY 1 ORDER BY n DESC, label LIMIT 20""")
def f14(t):
    return t.courses.groupBy(F.coalesce(X.nonempty(F.trim("level")), F.lit("-")).alias("label")).agg(n()).orderBy(F.desc("n"), "label").limit(20)


@query("F15_top_colleges", """SELECT college_id, min(name) AS name, count(*) AS n, CAST(sum(CASE WHEN fees_amount > 50000 THEN 1 ELSE 0 END) AS BIGINT) AS dear FROM offerings JOIN colleges USING (college_id) GROUP BY college_id ORDER BY n DESC, college_id LIMIT 25""")
def f15(t):
    g = t.offerings.groupBy("college_id").agg(n(), F.count_if(F.col("fees_amount") > 50_000).alias("dear"))
    return g.join(t.colleges.select("college_id", "name"), "college_id").orderBy(F.desc("n"), "college_id").limit(25)


ENRICH = """WITH o AS (SELECT o.course_id, o.college_id, c.city, c.state_id, c.name, nullif(o.fees_amount, 0) AS fee, nullif(o.rating, 0) AS rating, o.ranking, o.id FROM offerings o LEFT JOIN colleges c ON o.college_id = c.college_id)"""


@query("F18_course_enrichment", ENRICH + """ SELECT course_id, count(DISTINCT college_id) AS colleges, count(DISTINCT nullif(city, '')) AS cities, count(DISTINCT state_id) AS states, min(fee) AS min_fee, CAST(trunc(avg(fee)) AS BIGINT) AS avg_fee, max(fee) AS max_fee, round(avg(rating), 2) AS avg_rating FROM o GROUP BY course_id""")
def f18(t):
    """A course's rows meet once, by course; its colleges, cities and states are counted where they come first."""
    o = t.offerings.select("course_id", "college_id", X.nonzero(F.col("fees_amount")).alias("fee"), X.nonzero(F.col("rating")).alias("rated"))
    o = o.join(t.colleges.select("college_id", X.nonempty(F.col("city")).alias("city"), "state_id"), "college_id", "left").repartition("course_id")
    first = lambda c: F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy("course_id", c).orderBy("college_id")) == 1)
    o = o.withColumns({f"_{c}": first(c) for c in ("college_id", "city", "state_id")})
    return o.groupBy("course_id").agg(
        F.count_if("_college_id").alias("colleges"), F.count_if("_city").alias("cities"), F.count_if("_state_id").alias("states"),
        F.min("fee").alias("min_fee"), F.avg("fee").cast("long").alias("avg_fee"), F.max("fee").alias("max_fee"), F.round(F.avg("rated"), 2).alias("avg_rating"),
    )


@query("F20_qa_counters", """SELECT count(*) AS total, count(*) FILTER (WHERE website IS NULL OR website = '') AS no_website, count(*) FILTER (WHERE phone IS NULL OR phone = '') AS no_phone, count(*) FILTER (WHERE rating < 0) AS below_zero, (SELECT count(*) FROM (SELECT city FROM colleges GROUP BY city HAVING count(*) > 3)) AS crowded_cities FROM colleges""")
def f20(t):
    c = t.colleges
    crowded = c.groupBy("city").agg(n()).where("n > 3").agg(n("crowded_cities"))
    one = c.agg(n("total"), F.count_if(X.missing(F.col("website"))).alias("no_website"), F.count_if(X.missing(F.col("phone"))).alias("no_phone"), F.count_if(F.col("rating") < 0).alias("below_zero"))
    return one.join(crowded)  # two single rows


@query("F21_headline", """SELECT 'courses' AS what, count(*) AS n FROM courses UNION ALL SELECT 'colleges', count(*) FROM colleges UNION ALL SELECT 'offerings', count(*) FROM offerings UNION ALL SELECT 'directory', count(*) FROM directory""")
def f21(t):
    one = lambda name: getattr(t, name).agg(n()).select(F.lit(name).alias("what"), "n")
    return one("courses").union(one("colleges")).union(one("offerings")).union(one("directory"))


@query("F23_forecast", """SELECT count(*) AS n, CAST(sum(college_count) AS BIGINT) AS expected, CAST(sum((college_count + 9) // 10) AS BIGINT) AS pages FROM courses""")
def f23(t):
    return t.courses.agg(n(), F.sum("college_count").alias("expected"), F.sum(F.expr("(college_count + 9) div 10")).alias("pages"))


@query("F24_backfilled_counts", """SELECT c.course_id, coalesce(n, 0) AS n FROM courses c LEFT JOIN (SELECT course_id, count(*) AS n FROM offerings WHERE ranking > 30 GROUP BY course_id) o ON c.course_id = o.course_id""")
def f24(t):
    counts = t.offerings.where("ranking > 30").groupBy("course_id").agg(n())
    return t.courses.join(counts, "course_id", "left").select("course_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("F25_counts_of_counts", """SELECT round(avg(n), 3) AS mean, max(n) AS most FROM (SELECT college_id, count(*) AS n FROM offerings GROUP BY college_id)""")
def f25(t):
    return t.offerings.groupBy("college_id").agg(n()).agg(F.round(F.avg("n"), 3).alias("mean"), F.max("n").alias("most"))


@query("F26_capped_buckets", """SELECT CASE WHEN n >= 10 THEN '10+' ELSE CAST(n AS STRING) END AS bucket, count(*) AS colleges FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1""")
def f26(t):
    return t.read("orders").groupBy("o_custkey").agg(n()).groupBy(R.capped_count(F.col("n")).alias("bucket")).agg(n("colleges")).orderBy(F.regexp_replace("bucket", "[+]", "").cast("int"))


@query("F27_shared_names", """SELECT name, count(*) AS n, min(course_id) AS lowest, max(course_id) AS highest FROM courses GROUP BY name HAVING count(DISTINCT stream) > 1""")
def f27(t):
    g = t.courses.groupBy("name").agg(n(), F.min("course_id").alias("lowest"), F.max("course_id").alias("highest"), F.countDistinct("stream").alias("s"))
    return g.where("s > 1").drop("s")


@query("F31_log_summary", """SELECT level, job_id, count(*) AS n FROM logs GROUP BY level, job_id ORDER BY n DESC, level, job_id LIMIT 15""")
def f31(t):
    return t.logs.groupBy("level", "job_id").agg(n()).orderBy(F.desc("n"), "level", "job_id").limit(15)


@query("F37_job_rates", """SELECT job_id, count(*) AS units, round(sum(value) / count(*), 3) AS kb_per_unit, CAST(max(id) - min(id) AS BIGINT) AS span FROM logs GROUP BY job_id""")
def f37(t):
    return t.logs.groupBy("job_id").agg(n("units"), F.round(F.sum("value") / F.count(F.lit(1)), 3).alias("kb_per_unit"), (F.max("id") - F.min("id")).alias("span"))


# ---- ranking (G) ----


@query("G1_top_colleges_per_course", """SELECT course_id, college_id, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY CASE WHEN ranking > 0 THEN ranking ELSE 9999999 END, fees_amount DESC, id) AS pos FROM offerings) WHERE pos <= 5""")
def g1(t):
    order = [F.when(F.col("ranking") > 0, F.col("ranking")).otherwise(9_999_999), F.desc("fees_amount"), F.col("id")]
    return R.top_k(t.offerings, ["course_id"], order, 5, "pos").select("course_id", "college_id", "id", "pos")


@query("G2_state_spread", """SELECT course_id, string_agg(concat(CAST(state_id AS STRING), ':', CAST(n AS STRING)), ',' ORDER BY n DESC, state_id) AS spread FROM (SELECT course_id, state_id, count(DISTINCT college_id) AS n FROM offerings JOIN colleges USING (college_id) WHERE state_id IS NOT NULL GROUP BY course_id, state_id) GROUP BY course_id""")
def g2(t):
    """Colleges are counted along their order, so that a task holds no table of all pairs of course and college."""
    o = t.offerings.select("course_id", "college_id").join(t.colleges.where("state_id is not null").select("college_id", "state_id"), "college_id").repartition("course_id")
    place = F.dense_rank().over(Window.partitionBy("course_id", "state_id").orderBy("college_id"))
    g = o.withColumn("n", place.cast("long")).groupBy("course_id", "state_id").agg(F.max("n").alias("n"))
    top = R.top_k(g, ["course_id"], [F.desc("n"), F.col("state_id")], 12)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "state_id", "n").alias("x"))))
    return top.groupBy("course_id").agg(F.array_join(F.transform(listed, lambda s: s["x"]), ",").alias("spread"))


@query("G3_top_ranked", """SELECT id, ranking FROM offerings WHERE ranking > 0 ORDER BY ranking, id LIMIT 50""")
def g3(t):
    return t.offerings.where("ranking > 0").select("id", "ranking").orderBy("ranking", "id").limit(50)


@query("G5_keep_last_logs", """SELECT job_id, id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id DESC) AS r FROM logs) WHERE r <= 3""")
def g5(t):
    return R.top_k(t.logs, ["job_id"], [F.desc("id")], 3).select("job_id", "id")


@query("G6_latest_per_level", """SELECT level, arg_max(id, {'ts': ts, 'id': id}) AS id, max(ts) AS ts FROM logs GROUP BY level""")
def g6(t):
    return t.logs.groupBy("level").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))


@query("G9_widest_ranges", """SELECT course_id, min(fees_amount) AS low, max(fees_amount) AS high FROM offerings GROUP BY course_id ORDER BY max(fees_amount) - min(fees_amount) DESC, course_id LIMIT 20""")
def g9(t):
    return t.offerings.groupBy("course_id").agg(F.min("fees_amount").alias("low"), F.max("fees_amount").alias("high")).orderBy(F.desc(F.col("high") - F.col("low")), "course_id").limit(20)


@query("G10_upper_median", """SELECT level, list_sort(list(college_count))[CAST(count(*) // 2 AS BIGINT) + 1] AS median FROM courses GROUP BY level""")
def g10(t):
    return R.upper_median(t.courses, "level", "college_count")


@query("G11_cross_table", """SELECT stream, count(*) FILTER (WHERE level = 'UG') AS UG, count(*) FILTER (WHERE level = 'PG') AS PG, count(*) FILTER (WHERE level = '') AS blank FROM courses GROUP BY stream""")
def g11(t):
    p = t.courses.groupBy("stream").pivot("level", ["UG", "PG", ""]).agg(n()).fillna(0)
    return p.toDF("stream", "UG", "PG", "blank")


# ---- functions (H, I) ----


@query("H1_fee_text", """SELECT course_id, fee, CAST(fee_units AS BIGINT) AS fee_units FROM (SELECT p_partkey AS course_id, concat('INR ', CAST(p_size AS STRING), CASE p_size % 4 WHEN 0 THEN ' Lakh' WHEN 1 THEN ' k' WHEN 2 THEN ' Cr' ELSE '' END) AS fee, p_size * (CASE p_size % 4 WHEN 0 THEN 100000 WHEN 1 THEN 1000 WHEN 2 THEN 10000000 ELSE 1 END) AS fee_units FROM part)""")
def h1(t):
    unit = F.expr("CASE p_size % 4 WHEN 0 THEN ' Lakh' WHEN 1 THEN ' k' WHEN 2 THEN ' Cr' ELSE '' END")
    df = t.read("part").select(F.col("p_partkey").alias("course_id"), F.concat(F.lit("INR "), F.col("p_size").cast("string"), unit).alias("fee"))
    return df.withColumn("fee_units", X.fee_to_units(F.col("fee")))


@query("H4_durations", """SELECT p_partkey AS course_id, CAST(p_size AS INTEGER) * 12 + 6 AS months FROM part""")
def h4(t):
    return t.read("part").select(F.col("p_partkey").alias("course_id"), X.duration_months(F.concat(F.col("p_size").cast("string"), F.lit(" Years 6 months"))).alias("months"))


@query("H12_domains", r"""SELECT host, count(*) AS n FROM (SELECT CASE WHEN contains(h, '.') AND length(h) > 4 THEN h END AS host FROM (SELECT regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^([^/?:]*)', 1), '^www\.', '') AS h FROM pages)) GROUP BY host""")
def h12(t):
    return t.pages.groupBy(X.domain(F.col("url")).alias("host")).agg(n())


@query("H13_phone_keys", """SELECT college_id, CASE WHEN length(d) >= 10 THEN right(d, 10) WHEN d IS NULL THEN '' ELSE '' END AS phone_key FROM (SELECT college_id, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM directory)""")
def h13(t):
    return t.directory.select("college_id", F.coalesce(X.phone_key(F.col("phone")), F.lit("")).alias("phone_key"))


@query("H17_name_similarity", """WITH x AS (SELECT course_id, list_distinct(string_split(name, ' ')) AS a, list_distinct(string_split('small red widget', ' ')) AS b FROM courses) SELECT course_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS score FROM x""")
def h17(t):
    return t.courses.select("course_id", F.round(X.jaccard(X.tokens(F.col("name")), X.tokens(F.lit("small red widget"))), 6).alias("score"))


@query("H27_partition_keys", """SELECT course_id, concat('level=', level, '|stream=', stream) AS pkey FROM courses""")
def h27(t):
    pairs = F.array(F.concat(F.lit("stream="), "stream"), F.concat(F.lit("level="), "level"))
    return t.courses.select("course_id", F.array_join(F.array_sort(pairs), "|").alias("pkey"))


@query("H30_event_days", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM logs GROUP BY 1""")
def h30(t):
    return t.logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n())


@query("I4_payload_keys", """SELECT k AS payload_key, count(*) AS present, count(*) FILTER (WHERE coalesce(v, '') NOT IN ('', '0')) AS filled FROM (SELECT 'k' AS k, json_extract_string(props, '$.k') AS v FROM logs) GROUP BY k""")
def i4(t):
    pairs = F.explode(F.from_json("props", "map<string,string>")).alias("payload_key", "v")
    return t.logs.select(pairs).groupBy("payload_key").agg(n("present"), F.count_if(~F.coalesce("v", F.lit("")).isin("", "0")).alias("filled"))


@query("I7_flags", """SELECT id, contains(props, '"k"') AS has_k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM logs""")
def i7(t):
    v = F.try_parse_json("props")
    return t.logs.select("id", F.array_contains(F.json_object_keys("props"), "k").alias("has_k"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


# ---- writes and governance (J, K) ----

BATCH = "(SELECT college_id, CASE WHEN college_id % 3 = 0 THEN '' ELSE concat('new', CAST(college_id AS STRING)) END AS name, CASE WHEN college_id % 2 = 0 THEN NULL ELSE city END AS city FROM directory)"


def batch(t):
    d = t.directory
    name = F.when(F.col("college_id") % 3 == 0, "").otherwise(F.concat(F.lit("new"), F.col("college_id").cast("string")))
    return d.select("college_id", name.alias("name"), F.when(F.col("college_id") % 2 != 0, F.col("city")).alias("city"))


def written(policy: str) -> str:
    one = {"J1": "s.{c}", "J2": "CASE WHEN coalesce(s.{c}, '') = '' THEN t.{c} ELSE s.{c} END", "J3": "CASE WHEN coalesce(t.{c}, '') = '' THEN s.{c} ELSE t.{c} END"}[policy]
    col = lambda c: f"CASE WHEN t.college_id IS NULL THEN s.{c} WHEN s.college_id IS NULL THEN t.{c} ELSE {one.format(c=c)} END AS {c}"
    return f"SELECT coalesce(t.college_id, s.college_id) AS college_id, {col('name')}, {col('city')}, t.rating FROM colleges t FULL OUTER JOIN {BATCH} s ON t.college_id = s.college_id"


def target(t):
    return t.colleges.select("college_id", "name", "city", "rating")


@query("J1_overwrite_upsert", written("J1"))
def j1(t):
    return merge.upsert(target(t), batch(t), ["college_id"], merge.overwrite)


@query("J2_preserve_upsert", written("J2"))
def j2(t):
    return merge.upsert(target(t), batch(t), ["college_id"], merge.preserve)


@query("J3_fill_empty_upsert", written("J3"))
def j3(t):
    return merge.upsert(target(t), batch(t), ["college_id"], merge.fill_empty)


@query("J4_insert_if_absent", f"SELECT college_id, name, city, rating FROM colleges UNION ALL SELECT s.college_id, s.name, s.city, CAST(NULL AS DOUBLE) FROM {BATCH} s WHERE NOT EXISTS (SELECT 1 FROM colleges t WHERE t.college_id = s.college_id)")
def j4(t):
    return merge.insert_if_absent(target(t), batch(t), ["college_id"])


@query("J5_update_only", f"SELECT t.college_id, CASE WHEN coalesce(s.name, '') = '' THEN t.name ELSE s.name END AS name, CASE WHEN coalesce(s.city, '') = '' THEN t.city ELSE s.city END AS city, t.rating FROM colleges t LEFT JOIN {BATCH} s ON t.college_id = s.college_id")
def j5(t):
    return merge.update_only(target(t), batch(t), ["college_id"])


@query("J6_guarded_upsert", """SELECT p.college_id, CASE WHEN p.status IN ('done', 'empty') OR d.college_id IS NULL THEN p.status ELSE 'queued' END AS status FROM progress p LEFT JOIN directory d ON d.college_id = p.college_id UNION ALL SELECT d.college_id, 'queued' FROM directory d WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.college_id = d.college_id)""")
def j6(t):
    new = t.directory.select("college_id", F.lit("queued").alias("status"))
    return merge.upsert(t.progress.select("college_id", "status"), new, ["college_id"], guard=~F.col("t.status").isin("done", "empty"))


@query("J9_last_row_wins", """SELECT course_id, college_id, id, fees_amount FROM (SELECT *, row_number() OVER (PARTITION BY course_id, college_id ORDER BY scraped_at DESC, id DESC) AS r FROM offerings) WHERE r = 1""")
def j9(t):
    return merge.last_wins(t.offerings, ["course_id", "college_id"], ["scraped_at", "id"]).select("course_id", "college_id", "id", "fees_amount")


@query("J11_junk_deleted", """SELECT course_id FROM courses WHERE name IS NULL OR NOT (name ILIKE '%cold%')""")
def j11(t):
    return t.courses.where(~F.coalesce(F.col("name").ilike("%cold%"), F.lit(False))).select("course_id")


@query("K2_staged_diff", f"""SELECT count(*) AS staged, count(*) FILTER (WHERE t.college_id IS NULL) AS new_rows, count(*) FILTER (WHERE t.college_id IS NOT NULL) AS updates FROM {BATCH} s LEFT JOIN colleges t ON t.college_id = s.college_id""")
def k2(t):
    s, known = batch(t), t.colleges.select("college_id", F.lit(True).alias("known"))
    return s.join(known, "college_id", "left").agg(n("staged"), F.count_if(F.col("known").isNull()).alias("new_rows"), F.count_if("known").alias("updates"))


@query("K3_batch_scores", """SELECT job, rows_n, score, rows_n >= 100 AND score >= 70 AS passed FROM (SELECT source_job_id AS job, count(*) AS rows_n, round(greatest(0, 100 - CASE WHEN count(*) < 100 THEN 50 ELSE 0 END - least(40.0, greatest(0.0, 100.0 * count(*) FILTER (WHERE rating = 0) / count(*) - 20.0)) - least(20.0, count(*) FILTER (WHERE fees_amount < 1500))), 1) AS score FROM offerings GROUP BY source_job_id)""")
def k3(t):
    g = t.offerings.groupBy(F.col("source_job_id").alias("job")).agg(n("rows_n"), F.count_if(F.col("rating") == 0).alias("m"), F.count_if(F.col("fees_amount") < 1500).alias("b"))
    score = R.batch_score(F.col("rows_n"), 100.0 * F.col("m") / F.col("rows_n"), F.col("b"), 100, 20.0)
    return g.select("job", "rows_n", score.alias("score"), ((F.col("rows_n") >= 100) & (score >= 70)).alias("passed"))


@query("K9_promoted_share", """SELECT count(*) AS advertised, count(c.college_id) AS promoted, count(c.college_id) >= 0.95 * count(*) AS passed FROM directory d LEFT JOIN colleges c ON c.college_id = d.college_id""")
def k9(t):
    known = t.colleges.select("college_id", F.lit(True).alias("k"))
    return t.directory.join(known, "college_id", "left").agg(n("advertised"), F.count_if("k").alias("promoted")).withColumn("passed", F.col("promoted") >= 0.95 * F.col("advertised"))


# ---- change detection (L) ----

BEFORE = "(SELECT course_id, name, stream, college_count, course_id % 11 = 0 AS gone FROM courses WHERE course_id % 10 <> 0)"
AFTER = "(SELECT course_id, CASE WHEN course_id % 7 = 0 THEN concat(name, ' x') ELSE name END AS name, stream, CASE WHEN course_id % 13 = 0 THEN college_count + 1 ELSE college_count END AS college_count FROM courses)"


def states(t):
    c = t.courses.select("course_id", "name", "stream", "college_count")
    tracked = ["name", "stream", "college_count"]
    before = cdc.with_fingerprint(c.where("course_id % 10 <> 0"), tracked).withColumn("inactive_since", F.when(F.col("course_id") % 11 == 0, F.lit("2024-01-01")))
    after = c.withColumn("name", F.when(F.col("course_id") % 7 == 0, F.concat("name", F.lit(" x"))).otherwise(F.col("name"))).withColumn("college_count", F.when(F.col("course_id") % 13 == 0, F.col("college_count") + 1).otherwise(F.col("college_count")))
    return before, after, tracked


@query("L2_fingerprints", """SELECT course_id, sha1(concat('college_count', chr(31), CAST(college_count AS STRING), chr(30), 'name', chr(31), trim(name), chr(30))) AS content_hash FROM courses""")
def l2(t):
    return cdc.with_fingerprint(t.courses, ["name", "college_count"]).select("course_id", "content_hash")


@query("L3_field_changes", f"""SELECT b.course_id, 'name' AS field, b.name AS old_value, a.name AS new_value FROM {BEFORE} b JOIN {AFTER} a ON a.course_id = b.course_id WHERE a.name <> b.name UNION ALL SELECT b.course_id, 'college_count', CAST(b.college_count AS STRING), CAST(a.college_count AS STRING) FROM {BEFORE} b JOIN {AFTER} a ON a.course_id = b.course_id WHERE a.college_count <> b.college_count""")
def l3(t):
    before, after, tracked = states(t)
    return cdc.field_changes(before, after, ["course_id"], tracked)


@query("L6_reconcile", f"""SELECT a.course_id, CASE WHEN b.course_id IS NULL THEN 'new' WHEN b.gone THEN 'returned' WHEN a.name <> b.name OR a.college_count <> b.college_count THEN 'changed' ELSE 'same' END AS verdict, CAST(CASE WHEN b.course_id IS NULL THEN 0 ELSE (CASE WHEN a.name <> b.name THEN 1 ELSE 0 END) + (CASE WHEN a.college_count <> b.college_count THEN 1 ELSE 0 END) END AS BIGINT) AS n_fields FROM {AFTER} a LEFT JOIN {BEFORE} b ON a.course_id = b.course_id""")
def l6(t):
    before, after, tracked = states(t)
    return cdc.reconcile(before, after, ["course_id"], tracked)


@query("L9_mark_missing", """SELECT college_id, CASE WHEN updated_at < TIMESTAMP '1998-06-01 00:00:00' THEN TIMESTAMP '1998-06-01 00:00:00' END AS inactive_since FROM progress""")
def l9(t):
    import datetime

    df = t.progress.withColumn("inactive_since", F.lit(None).cast(t.progress.schema["updated_at"].dataType))
    start = datetime.datetime(1998, 6, 1)
    return cdc.mark_missing(df, start, seen="updated_at").select("college_id", "inactive_since")


@query("L15_freshness", """SELECT source_job_id % 5 AS grp, count(*) AS total, count(*) FILTER (WHERE scraped_at < TIMESTAMP '1996-01-01 00:00:00') AS stale, max(scraped_at) AS newest FROM offerings GROUP BY 1""")
def l15(t):
    stale = F.col("scraped_at") < F.lit("1996-01-01 00:00:00").cast("timestamp")
    return t.offerings.groupBy((F.col("source_job_id") % 5).alias("grp")).agg(n("total"), F.count_if(stale).alias("stale"), F.max("scraped_at").alias("newest"))


# ---- queues (M) ----


@query("M1_pending_by_size", """SELECT c.course_id, college_count FROM courses c LEFT JOIN (SELECT DISTINCT course_id FROM offerings WHERE ranking > 40) o ON o.course_id = c.course_id WHERE o.course_id IS NULL AND coalesce(college_count, 0) >= 5 ORDER BY college_count DESC, c.course_id LIMIT 300""")
def m1(t):
    done = t.offerings.where("ranking > 40").select("course_id", F.lit("done").alias("status"))
    q = R.pending(t.courses, done, "course_id").where(F.coalesce("college_count", F.lit(0)) >= 5)
    return q.select("course_id", "college_count").orderBy(F.desc("college_count"), "course_id").limit(300)


@query("M2_forecast_by_state", """SELECT coalesce(p.status, 'left') AS status, count(*) AS n, CAST(sum(coalesce(p.found, 0)) AS BIGINT) AS found, CAST(sum((coalesce(p.found, 0) + 9) // 10) AS BIGINT) AS pages FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id GROUP BY 1""")
def m2(t):
    q = t.directory.join(t.progress, "college_id", "left").select(F.coalesce("status", F.lit("left")).alias("status"), F.coalesce("found", F.lit(0)).alias("found"))
    return q.groupBy("status").agg(n(), F.sum("found").alias("found_n"), F.sum(F.expr("(found + 9) div 10")).alias("pages")).withColumnRenamed("found_n", "found")


@query("M6_missing_urls", """SELECT count(*) FILTER (WHERE website IS NULL) AS null_url, count(*) FILTER (WHERE website = '') AS blank_url, count(DISTINCT CASE WHEN coalesce(website, '') = '' THEN college_id END) AS ids FROM colleges""")
def m6(t):
    w = F.col("website")
    return t.colleges.agg(F.count_if(w.isNull()).alias("null_url"), F.count_if(w == "").alias("blank_url"), F.countDistinct(F.when(X.missing(w), F.col("college_id"))).alias("ids"))


# ---- gaps (N) ----


@query("N14_gap_profile", """SELECT CASE WHEN p.status IN ('done', 'empty') THEN 'matched' WHEN p.status = 'error' THEN 'pending' ELSE 'none' END AS bucket, count(*) AS n, count(*) FILTER (WHERE coalesce(trim(d.website), '') <> '') AS searchable FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id GROUP BY 1""")
def n14(t):
    bucket = F.when(F.col("status").isin("done", "empty"), "matched").when(F.col("status") == "error", "pending").otherwise("none")
    return t.directory.join(t.progress, "college_id", "left").groupBy(bucket.alias("bucket")).agg(n(), F.count_if(~X.missing(F.trim(F.coalesce("website", F.lit(""))))).alias("searchable"))


# ---- audits (O) ----


@query("O1_completeness", """SELECT column_name, CAST(filled AS BIGINT) AS filled, total, round(100.0 * filled / total, 2) AS percent FROM (SELECT 'website' AS column_name, count(nullif(website, '')) AS filled, count(*) AS total FROM colleges UNION ALL SELECT 'phone', count(nullif(phone, '')), count(*) FROM colleges UNION ALL SELECT 'city', count(nullif(city, '')), count(*) FROM colleges)""")
def o1(t):
    return R.completeness(t.colleges, ["website", "phone", "city"]).select("column_name", "filled", "total", "percent")


@query("O2_gap_counters", """SELECT 'directory not in colleges' AS what, count(*) AS n FROM directory WHERE college_id NOT IN (SELECT college_id FROM colleges) UNION ALL SELECT 'colleges without offerings', count(*) FROM colleges WHERE college_id NOT IN (SELECT college_id FROM offerings) UNION ALL SELECT 'offerings without course', count(*) FROM offerings WHERE course_id NOT IN (SELECT course_id FROM courses)""")
def o2(t):
    one = lambda what, df: df.agg(n()).select(F.lit(what).alias("what"), "n")
    anti = lambda a, b, k: a.join(b.select(k), k, "left_anti")
    return (
        one("directory not in colleges", anti(t.directory, t.colleges, "college_id"))
        .union(one("colleges without offerings", anti(t.colleges, t.offerings, "college_id")))
        .union(one("offerings without course", anti(t.offerings, t.courses, "course_id")))
    )


# ---- streams, sweeps and panels (P, S, T) ----


@query("P6_hourly_counts", """SELECT date_trunc('hour', ts) AS hour, level AS event_type, count(*) AS n, round(sum(value), 2) AS total FROM logs GROUP BY 1, 2""")
def p6(t):
    """The same plan as the stream's, over the whole table."""
    return S.windowed_counts(t.read("events")).select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("P7_sessions", """WITH e AS (SELECT job_id AS user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM logs), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def p7(t):
    return S.sessions(t.read("events")).select("user_id", F.col("w.start").alias("began"), "n")


@query("S2_filter_options", """SELECT DISTINCT 'stream' AS what, stream AS value FROM courses UNION ALL SELECT DISTINCT 'city', city FROM directory""")
def s2(t):
    return t.courses.select(F.lit("stream").alias("what"), F.col("stream").alias("value")).distinct().union(t.directory.select(F.lit("city"), "city").distinct())


@query("S6_priciest", """SELECT id, fees_amount FROM offerings ORDER BY fees_amount DESC, id LIMIT 25""")
def s6(t):
    return t.offerings.select("id", "fees_amount").orderBy(F.desc("fees_amount"), "id").limit(25)


@query("T3_two_level_dedupe", """SELECT course_id, name, course_type FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(course_type) ORDER BY course_id) AS r FROM courses) WHERE r = 1""")
def t3(t):
    w = [F.lower("name"), F.lower("course_type")]
    return R.top_k(t.courses, w, [F.col("course_id")], 1).select("course_id", "name", "course_type")


@query("T5_terminal_status", """SELECT college_id, CASE WHEN status = 'error' THEN 'partial' WHEN found > 8 THEN 'done' ELSE 'empty' END AS status FROM progress""")
def t5(t):
    return t.progress.select("college_id", F.when(F.col("status") == "error", "partial").when(F.col("found") > 8, "done").otherwise("empty").alias("status"))


@query("T6_advertised_audit", """SELECT c.course_id, c.college_count AS expected, coalesce(n, 0) AS found, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN coalesce(n, 0) < c.college_count THEN 'short' ELSE 'whole' END AS verdict FROM courses c LEFT JOIN (SELECT course_id, count(DISTINCT college_id) AS n FROM offerings GROUP BY course_id) o ON o.course_id = c.course_id""")
def t6(t):
    found = F.coalesce("n", F.lit(0))
    o = t.offerings.groupBy("course_id").agg(F.countDistinct("college_id").alias("n"))
    verdict = F.when(found == 0, "none").when(found < F.col("college_count"), "short").otherwise("whole")
    return t.courses.join(o, "course_id", "left").select("course_id", F.col("college_count").alias("expected"), found.alias("found"), verdict.alias("verdict"))
