"""Registered queries of panels, reports, audits and work queues."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from .catalogue import n, query


def probes(*named: tuple[str, DataFrame]) -> DataFrame:
    """(what, n): a count for each named table."""
    return reduce(DataFrame.union, (df.agg(n()).select(F.lit(what).alias("what"), "n") for what, df in named))


def probes_sql(*named: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{what}' AS what, count(*) AS n FROM {source}" for what, source in named)


# ---- distributions (F) ----

FEES_2 = ((2_500, "up to 2.5k"), (7_500, "2.5k-7.5k"), (15_000, "7.5k-15k"), (30_000, "15k-30k"), (50_000, "30k-50k"), (75_000, "50k-75k"), (None, "over 75k"))
TUITION = ((950, "under 950"), (1_000, "950-1000"), (1_050, "1000-1050"), (1_100, "1050-1100"), (1_200, "1100-1200"), (None, "1200 and more"))


def buckets_sql(value: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {e} THEN '{label}'" if e is not None else f"ELSE '{label}' END" for e, label in edges)


@query("F8_fee_histogram_wide", f"SELECT {buckets_sql('fees_amount', FEES_2)} AS bucket, count(*) AS n, min(fees_amount) AS lowest FROM offerings WHERE fees_amount > 0 GROUP BY 1")
def f8(t):
    return R.histogram(t.offerings.where("fees_amount > 0"), F.col("fees_amount"), FEES_2)


@query("F10_tuition_histogram", f"SELECT {buckets_sql('p_retailprice', TUITION)} AS bucket, count(*) AS n, min(p_retailprice) AS lowest FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1")
def f10(t):
    return R.histogram(t.read("part"), F.col("p_retailprice"), TUITION)


@query("F11_colleges_by_place", "SELECT * FROM (SELECT 'city' AS dim, city AS value, count(*) AS n FROM colleges GROUP BY city ORDER BY n DESC, value LIMIT 15) UNION ALL SELECT 'state', CAST(state_id AS VARCHAR), count(*) FROM colleges GROUP BY state_id")
def f11(t):
    city = t.colleges.groupBy(F.lit("city").alias("dim"), F.col("city").alias("value")).agg(n()).orderBy(F.desc("n"), "value").limit(15)
    return city.union(t.colleges.groupBy(F.lit("state").alias("dim"), F.col("state_id").cast("string").alias("value")).agg(n()))


LEVELS = "(SELECT course_id, CASE WHEN course_id % 12 = 0 THEN NULL ELSE level END AS level FROM courses)"


@query("F16_raw_groups", f"SELECT coalesce(nullif(trim(level), ''), '?') AS label, n FROM (SELECT level, count(*) AS n FROM {LEVELS} GROUP BY level)")
def f16(t):
    """Groups of the raw values; absent ones share a label but not a row."""
    raw = t.courses.select(F.when(F.col("course_id") % 12 != 0, F.col("level")).alias("level")).groupBy("level").agg(n())
    return raw.select(F.coalesce(X.nonempty(F.trim("level")), F.lit("?")).alias("label"), "n")


@query("F17_programmes_by", "SELECT dim, value, count(*) AS n FROM (SELECT 'tag' AS dim, p_brand AS value FROM part UNION ALL SELECT 'mode', p_type FROM part UNION ALL SELECT 'exam', concat('E', CAST(p_size % 4 AS VARCHAR)) FROM part UNION ALL SELECT 'currency', CASE WHEN p_size % 2 = 0 THEN 'USD' ELSE 'EUR' END FROM part) GROUP BY dim, value")
def f17(t):
    p = t.read("part").select(F.col("p_brand").alias("tag"), F.col("p_type").alias("mode"), F.concat(F.lit("E"), F.col("p_size") % 4).alias("exam"), F.when(F.col("p_size") % 2 == 0, "USD").otherwise("EUR").alias("currency"))
    return p.unpivot([], ["tag", "mode", "exam", "currency"], "dim", "value").groupBy("dim", "value").agg(n())


@query("F18_top_lists", """SELECT course_id, string_agg(concat(CAST(college_id AS VARCHAR), ':', CAST(coalesce(fee, -1) AS VARCHAR), ':', CAST(rk AS VARCHAR)), ',' ORDER BY pos) AS top5 FROM (SELECT o.course_id, o.college_id, nullif(o.fees_amount, 0) AS fee, CASE WHEN o.ranking > 0 THEN o.ranking ELSE 9999999 END AS rk,
 row_number() OVER (PARTITION BY o.course_id ORDER BY CASE WHEN o.ranking > 0 THEN o.ranking ELSE 9999999 END, nullif(o.fees_amount, 0) DESC NULLS LAST, o.college_id, o.id) AS pos FROM offerings o JOIN colleges c ON c.college_id = o.college_id WHERE c.name <> '') WHERE pos <= 5 GROUP BY course_id""")
def f18_top(t):
    """The five best offerings of each course as one list."""
    o = t.offerings.join(t.colleges.where("name <> ''").select("college_id"), "college_id", "left_semi")
    o = o.select("course_id", "college_id", "id", X.nonzero(F.col("fees_amount")).alias("fee"), F.when(F.col("ranking") > 0, F.col("ranking")).otherwise(9_999_999).alias("rk"))
    top = R.top_k(o, ["course_id"], [F.col("rk"), F.col("fee").desc_nulls_last(), F.col("college_id"), F.col("id")], 5, "pos")
    one = F.struct("pos", F.concat_ws(":", "college_id", F.coalesce("fee", F.lit(-1)), "rk").alias("x"))
    return top.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["x"]), ",").alias("top5"))


@query("F19_enrichment_summary", "SELECT count(*) AS n, max(scraped_at) AS newest, count(DISTINCT source_job_id) AS jobs FROM offerings WHERE rating > 0")
def f19(t):
    return t.offerings.where("rating > 0").agg(n(), F.max("scraped_at").alias("newest"), F.countDistinct("source_job_id").alias("jobs"))


QA = """SELECT count(*) AS total, count(*) FILTER (WHERE website IS NULL OR website = '') AS no_website, count(*) FILTER (WHERE phone IS NULL OR phone = '') AS no_phone, count(*) FILTER (WHERE rating < 0) AS below_zero,
 count(*) FILTER (WHERE city IS NULL OR city = '') AS no_city, count(*) FILTER (WHERE name IS NULL OR trim(name) = '') AS no_name, (SELECT count(*) FROM (SELECT phone FROM colleges WHERE phone <> '' GROUP BY phone HAVING count(*) > 1)) AS shared_phones FROM colleges"""


@query("F20_qa_report", QA)
def f20(t):
    c, lost = t.colleges, lambda x: F.count_if(X.missing(F.col(x))).alias(f"no_{x}")
    shared = c.where("phone <> ''").groupBy("phone").agg(n()).where("n > 1").agg(n("shared_phones"))
    one = c.agg(n("total"), lost("website"), lost("phone"), F.count_if(F.col("rating") < 0).alias("below_zero"), lost("city"), F.count_if(X.missing(F.trim("name"))).alias("no_name"))
    return one.join(shared)  # single rows


@query("F22_blank_counters", "SELECT count(*) AS n, count(*) FILTER (WHERE website IS NULL OR website = '') AS website, count(*) FILTER (WHERE phone IS NULL OR phone = '') AS phone, count(*) FILTER (WHERE city IS NULL OR city = '') AS city, count(*) FILTER (WHERE name IS NULL OR name = '') AS name FROM directory")
def f22(t):
    return t.directory.agg(n(), *(F.count_if(X.missing(F.col(c))).alias(c) for c in ("website", "phone", "city", "name")))


@query("F28_names_of_many", "SELECT name, count(DISTINCT stream) AS streams, count(*) AS n FROM courses GROUP BY name HAVING count(DISTINCT stream) > 1 ORDER BY streams DESC, name LIMIT 5")
def f28(t):
    return t.courses.groupBy("name").agg(F.countDistinct("stream").alias("streams"), n()).where("streams > 1").orderBy(F.desc("streams"), "name").limit(5)


HOSTS = "(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, length(html) AS size, len(regexp_extract_all(html, '(?i)<a href=\"([^\"]*)\"', 1)) AS links FROM pages)"


def hosts(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.length("html").alias("size"), F.size(F.regexp_extract_all("html", F.lit('(?i)<a href="([^"]*)"'), F.lit(1))).alias("links"))


@query("F29_harvest_totals", f"SELECT count(*) AS n, count(DISTINCT host) AS hosts, CAST(sum(size) AS BIGINT) AS size, CAST(sum(links) AS BIGINT) AS links FROM {HOSTS}")
def f29(t):
    return hosts(t).agg(n(), F.countDistinct("host").alias("hosts"), F.sum("size").alias("size"), F.sum("links").alias("links"))


@query("F30_offering_buckets", "SELECT CASE WHEN m <= 20 THEN '1-20' WHEN m <= 25 THEN '21-25' WHEN m <= 30 THEN '26-30' WHEN m <= 35 THEN '31-35' ELSE '36+' END AS bucket, count(*) AS courses, CAST(sum(m) AS BIGINT) AS offerings, round(avg(m), 3) AS mean FROM (SELECT course_id, count(*) AS m FROM offerings GROUP BY course_id) GROUP BY 1")
def f30(t):
    m = F.col("m")
    bucket = F.when(m <= 20, "1-20").when(m <= 25, "21-25").when(m <= 30, "26-30").when(m <= 35, "31-35").otherwise("36+")
    return t.offerings.groupBy("course_id").agg(n("m")).groupBy(bucket.alias("bucket")).agg(n("courses"), F.sum("m").alias("offerings"), F.round(F.avg("m"), 3).alias("mean"))


@query("F33_level_sets", "SELECT levels, count(*) AS colleges FROM (SELECT college_id, array_to_string(list_sort(list_distinct(list(level))), '+') AS levels FROM offerings JOIN courses USING (course_id) GROUP BY college_id) GROUP BY levels ORDER BY colleges DESC, levels LIMIT 20")
def f33(t):
    sets = t.offerings.join(t.courses, "course_id").groupBy("college_id").agg(F.array_join(F.array_sort(F.collect_set("level")), "+").alias("levels"))
    return sets.groupBy("levels").agg(n("colleges")).orderBy(F.desc("colleges"), "levels").limit(20)


STAGED = "(SELECT id AS staging_id, job_id, level AS table_name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pk, value FROM logs)"


def staged(t):
    return t.logs.select(F.col("id").alias("staging_id"), "job_id", F.col("level").alias("table_name"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("pk"), "value")


@query("F34_staged_by_table", f"SELECT table_name, count(*) AS staged, count(DISTINCT pk) AS row_keys, count(DISTINCT CASE WHEN value > 100 THEN pk END) AS promoted FROM {STAGED} GROUP BY table_name")
def f34(t):
    return staged(t).groupBy("table_name").agg(n("staged"), F.countDistinct("pk").alias("row_keys"), F.countDistinct(F.when(F.col("value") > 100, F.col("pk"))).alias("promoted"))


@query("F35_queue_status", "SELECT coalesce(p.status, 'never') AS status, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM directory), 2) AS percent FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id GROUP BY 1")
def f35(t):
    counts = t.directory.join(t.progress, "college_id", "left").groupBy(F.coalesce("status", F.lit("never")).alias("status")).agg(n())
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # a few rows


@query("F36_two_inventories", "WITH a AS (SELECT DISTINCT college_id FROM offerings WHERE ranking > 0), b AS (SELECT DISTINCT college_id FROM directory) SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM a WHERE college_id NOT IN (SELECT college_id FROM b)) AS only_a, (SELECT count(*) FROM b WHERE college_id NOT IN (SELECT college_id FROM a)) AS only_b")
def f36(t):
    return R.cross_source(t.offerings.where("ranking > 0"), t.directory, "college_id").select(F.col("n_a").alias("in_a"), F.col("n_b").alias("in_b"), "only_a", "only_b")


# ---- orderings (G) ----


def ordering(name: str):
    """Named orders of a course list."""
    return {
        "colleges_desc": [F.desc("college_count"), F.col("course_id")], "colleges_asc": [F.col("college_count"), F.col("course_id")],
        "stream": [F.col("stream"), F.desc("college_count"), F.col("course_id")],
    }[name]


@query("G4_named_orders", " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS ordered, course_id, row_number() OVER (ORDER BY {order}) AS pos FROM courses ORDER BY pos LIMIT 10)" for name, order in (("colleges_desc", "college_count DESC, course_id"), ("colleges_asc", "college_count, course_id"), ("stream", "stream, college_count DESC, course_id"))))
def g4(t):
    def first(name: str) -> DataFrame:
        few = t.courses.orderBy(*ordering(name)).limit(10)  # ten rows
        return few.select(F.lit(name).alias("ordered"), "course_id", F.row_number().over(Window.orderBy(*ordering(name))).alias("pos"))

    return first("colleges_desc").union(first("colleges_asc")).union(first("stream"))


@query("G7_log_tail", "SELECT id, job_id, level FROM logs WHERE id > 500 AND job_id = 7 ORDER BY id DESC LIMIT 50")
def g7(t):
    return t.logs.where("id > 500 and job_id = 7").select("id", "job_id", "level").orderBy(F.desc("id")).limit(50)


@query("G8_by_correlated_count", "SELECT c.college_id, c.name, coalesce(m, 0) AS offers FROM colleges c LEFT JOIN (SELECT college_id, count(*) AS m FROM offerings WHERE ranking > 25 GROUP BY college_id) o ON o.college_id = c.college_id ORDER BY offers DESC, c.college_id LIMIT 40")
def g8(t):
    counts = t.offerings.where("ranking > 25").groupBy("college_id").agg(n("m"))
    return t.colleges.join(counts, "college_id", "left").select("college_id", "name", F.coalesce("m", F.lit(0)).alias("offers")).orderBy(F.desc("offers"), "college_id").limit(40)


@query("G12_first_rows", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def g12(t):
    """A sample is the first rows by key, so that it is the same each time."""
    return t.pages.select("page_id", "url").orderBy("page_id").limit(20)


# ---- filters and joins (C, D, E) ----


@query("C8_browse", "SELECT o.id, c.stream, o.fees_amount FROM offerings o JOIN courses c USING (course_id) JOIN colleges k USING (college_id) WHERE o.fees_amount BETWEEN 10000 AND 30000 AND c.level = 'UG' AND k.state_id IN (1, 2) AND c.name ILIKE '%ring%'")
def c8(t):
    picked = t.courses.where((F.col("level") == "UG") & F.col("name").ilike("%ring%")).select("course_id", "stream")
    places = t.colleges.where(F.col("state_id").isin(1, 2)).select("college_id")
    return t.offerings.where(F.col("fees_amount").between(10_000, 30_000)).join(picked, "course_id").join(places, "college_id", "left_semi").select("id", "stream", "fees_amount")


@query("C9_quick_filter", "SELECT college_id, name, city FROM directory WHERE name ILIKE '%5%' OR city ILIKE '%5%' OR ownership ILIKE '%5%' ORDER BY college_id LIMIT 200")
def c9(t):
    """A term sought in every text column."""
    texts = [c for c, kind in t.directory.dtypes if kind == "string" and c in ("name", "city", "ownership")]
    hit = reduce(lambda a, b: a | b, (F.col(c).ilike("%5%") for c in texts))
    return t.directory.where(hit).select("college_id", "name", "city").orderBy("college_id").limit(200)


@query("C10_guarded_select", "SELECT stream, count(*) AS n FROM courses GROUP BY stream ORDER BY stream LIMIT 1000")
def c10(t):
    return R.guarded_select(t.spark, "SELECT stream, count(*) AS n FROM {courses} GROUP BY stream ORDER BY stream", courses=t.courses)


@query("C18_preview", "SELECT page_id, left(url, 300) AS url, left(html, 300) AS html FROM pages")
def c18(t):
    return R.preview(t.pages, drop=("raw_json",))


@query("D4_reverse_gap", "SELECT c.college_id, c.name FROM colleges c WHERE c.college_id NOT IN (SELECT college_id FROM directory WHERE ownership <> 'FURNITURE')")
def d4(t):
    """Colleges that the directory (but for one kind of owner) doesn't list."""
    return t.colleges.join(t.directory.where("ownership <> 'FURNITURE'"), "college_id", "left_anti").select("college_id", "name")


@query("D7_enrichment_toggle", " UNION ALL ".join(f"SELECT * FROM (SELECT '{how}' AS how, c.course_id, coalesce(e.m, 0) AS m FROM courses c {join} JOIN (SELECT course_id, count(*) AS m FROM offerings WHERE ranking > 45 GROUP BY course_id) e ON e.course_id = c.course_id ORDER BY m DESC, c.course_id LIMIT 20)" for how, join in (("left", "LEFT"), ("inner", ""))))
def d7(t):
    rich = t.offerings.where("ranking > 45").groupBy("course_id").agg(n("m"))
    one = lambda how: t.courses.join(rich, "course_id", how).select(F.lit(how).alias("how"), "course_id", F.coalesce("m", F.lit(0)).alias("m")).orderBy(F.desc("m"), "course_id").limit(20)
    return one("left").union(one("inner"))


@query("D9_detail_done_deep_open", "SELECT d.college_id FROM directory d JOIN (SELECT college_id FROM progress WHERE found > 5) p ON p.college_id = d.college_id LEFT JOIN (SELECT college_id FROM progress WHERE status = 'error') q ON q.college_id = d.college_id WHERE q.college_id IS NULL")
def d9(t):
    """Entities whose first pass is done and whose own pass isn't."""
    done, own = t.progress.where("found > 5").select("college_id"), t.progress.where("status = 'error'").select("college_id")
    return t.directory.join(done, "college_id", "left_semi").join(own, "college_id", "left_anti").select("college_id")


@query("D10_not_exists", "SELECT c.course_id FROM courses c WHERE NOT EXISTS (SELECT 1 FROM offerings o WHERE o.course_id = c.course_id AND o.ranking > 48)")
def d10(t):
    return t.courses.join(t.offerings.where("ranking > 48"), "course_id", "left_anti").select("course_id")


@query("E2_bridged_ids", "SELECT college_id, 'bridge' AS origin FROM directory WHERE college_id NOT IN (SELECT college_id FROM colleges) UNION ALL SELECT college_id, 'own' FROM colleges")
def e2(t):
    """Ids that only the other source knows are inserted, known ones stay."""
    own = t.colleges.select("college_id", F.lit("own").alias("origin"))
    new = t.directory.join(t.colleges, "college_id", "left_anti").select("college_id", F.lit("bridge").alias("origin"))
    return own.union(new)


@query("I8_drill_down", "SELECT course_id, college_id, fee FROM (SELECT course_id, college_id, fees_amount AS fee, row_number() OVER (PARTITION BY course_id ORDER BY fees_amount DESC, id) AS pos FROM offerings) WHERE pos <= 3")
def i8(t):
    """A stored list of the three dearest offerings, read back from its JSON."""
    top = R.top_k(t.offerings, ["course_id"], [F.desc("fees_amount"), F.col("id")], 3, "pos")
    stored = top.groupBy("course_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "college_id", F.col("fees_amount").alias("fee"))))).alias("top_json"))
    return stored.select("course_id", F.inline(F.from_json("top_json", "array<struct<pos:int,college_id:bigint,fee:bigint>>"))).drop("pos")


# ---- audits (O) ----

SANITY = (
    ("courses without level", "courses", "level = ''"), ("courses without offerings", "courses", "course_id NOT IN (SELECT course_id FROM offerings)"),
    ("colleges without website", "colleges", "coalesce(website, '') = ''"), ("colleges without phone", "colleges", "coalesce(phone, '') = ''"),
    ("offerings without rating", "offerings", "rating = 0"), ("offerings without rank", "offerings", "ranking = 0"), ("offerings under 1000", "offerings", "fees_amount < 1000"),
    ("offerings over 90000", "offerings", "fees_amount > 90000"), ("directory without website", "directory", "coalesce(website, '') = ''"),
    ("directory without phone", "directory", "phone IS NULL"), ("directory not in progress", "directory", "college_id NOT IN (SELECT college_id FROM progress)"),
    ("progress in error", "progress", "status = 'error'"),
)


@query("O3_coverage_sanity", probes_sql(*((what, f"{table} WHERE {rule}") for what, table, rule in SANITY)))
def o3(t):
    def probe(table: str, rule: str) -> DataFrame:
        df = getattr(t, table)
        if "NOT IN" not in rule:
            return df.where(rule)
        key, other = rule.split(" NOT IN ")[0], rule.split(" FROM ")[1].rstrip(")")
        return df.join(getattr(t, other), key, "left_anti")

    return probes(*((what, probe(table, rule)) for what, table, rule in SANITY))


JUNK = "name ILIKE '%cold%' OR substring(name, 1, 1) IN ('n', 'o') OR lower(trim(name)) IN ('red widget', 'small widget')"


@query("O4_junk_report", f"SELECT count(*) AS n, count(*) FILTER (WHERE {JUNK}) AS junk, (SELECT array_to_string(list(name ORDER BY course_id), ',') FROM (SELECT name, course_id FROM courses WHERE {JUNK} ORDER BY course_id LIMIT 5)) AS sample FROM courses")
def o4(t):
    c = F.col("name")
    junk = c.ilike("%cold%") | F.substring(c, 1, 1).isin("n", "o") | F.lower(F.trim(c)).isin("red widget", "small widget")
    few = t.courses.where(junk).select("course_id", "name").orderBy("course_id").limit(5)  # five rows
    sample = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("course_id", "name"))), lambda s: s["name"]), ",").alias("sample"))
    return t.courses.agg(n(), F.count_if(junk).alias("junk")).join(sample)  # single rows


@query("O5_programme_quality", "SELECT count(*) AS n, count(*) FILTER (WHERE p_retailprice < 950) AS cheap, count(*) FILTER (WHERE p_size = 0) AS no_size, count(*) FILTER (WHERE p_brand = '' OR p_brand IS NULL) AS no_brand, count(DISTINCT p_type) AS types, round(100.0 * count(*) FILTER (WHERE p_retailprice < 950) / count(*), 1) AS cheap_percent FROM part")
def o5(t):
    cheap = F.count_if(F.col("p_retailprice") < 950)
    return t.read("part").agg(n(), cheap.alias("cheap"), F.count_if(F.col("p_size") == 0).alias("no_size"), F.count_if(X.missing(F.col("p_brand"))).alias("no_brand"), F.countDistinct("p_type").alias("types"), F.round(100.0 * cheap / F.count(F.lit(1)), 1).alias("cheap_percent"))


@query("O6_discovery_checks", f"""SELECT 'pages' AS section, 'total' AS what, count(*) AS n FROM pages UNION ALL SELECT 'pages', 'without title', count(*) FROM pages WHERE NOT contains(html, '<title>') UNION ALL SELECT 'hosts', 'total', count(DISTINCT host) FROM {HOSTS}
 UNION ALL SELECT 'hosts', 'with one page', count(*) FROM (SELECT host FROM {HOSTS} GROUP BY host HAVING count(*) = 1) UNION ALL SELECT 'links', 'pages without', count(*) FROM {HOSTS} WHERE links = 0 UNION ALL SELECT 'urls', 'with query', count(*) FROM pages WHERE contains(url, '?')
 UNION ALL SELECT 'urls', 'repeated', count(*) FROM (SELECT url FROM pages GROUP BY url HAVING count(*) > 1) UNION ALL SELECT 'size', 'over 4000', count(*) FROM {HOSTS} WHERE size > 4000""")
def o6(t):
    """Eight checks of what a discovery run has stored."""
    h, p = hosts(t), t.pages
    one = lambda section, what, df: df.agg(n()).select(F.lit(section).alias("section"), F.lit(what).alias("what"), "n")
    parts = (
        one("pages", "total", p), one("pages", "without title", p.where(~F.contains("html", F.lit("<title>")))), one("hosts", "total", h.select("host").distinct()),
        one("hosts", "with one page", h.groupBy("host").agg(n("m")).where("m = 1")), one("links", "pages without", h.where("links = 0")), one("urls", "with query", p.where(F.contains("url", F.lit("?")))),
        one("urls", "repeated", p.groupBy("url").agg(n("m")).where("m > 1")), one("size", "over 4000", h.where("size > 4000")),
    )
    return reduce(DataFrame.union, parts)


@query("O7_fee_backfill", "SELECT p_partkey AS course_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) ELSE CAST(p_size AS BIGINT) * 100000 END AS fee FROM part")
def o7(t):
    """Fee texts are read again only where no number is stored."""
    p = t.read("part").select(F.col("p_partkey").alias("course_id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("long")).alias("stored"), F.concat(F.lit("₹ "), "p_size", F.lit(" Lakh")).alias("text"))
    return p.select("course_id", F.coalesce("stored", X.fee_to_units(F.col("text"))).alias("fee"))


@query("O10_table_overview", probes_sql(*((x, x) for x in ("courses", "colleges", "offerings", "directory", "progress", "logs", "pages"))))
def o10(t):
    return probes(*((x, getattr(t, x)) for x in ("courses", "colleges", "offerings", "directory", "progress", "logs", "pages")))


# ---- queues (M) ----

STALE = datetime.datetime(1997, 6, 1)


@query("M2_forecast_by_stream", "SELECT coalesce(stream, 'all') AS stream, count(*) AS n, CAST(sum(college_count) AS BIGINT) AS expected, CAST(sum((college_count + 9) // 10) AS BIGINT) AS pages, count(*) FILTER (WHERE done) AS done, CAST(coalesce(sum((college_count + 9) // 10) FILTER (WHERE NOT done), 0) AS BIGINT) AS pages_left FROM (SELECT c.stream, c.college_count, c.course_id IN (SELECT course_id FROM offerings WHERE ranking > 45) AS done FROM courses c) GROUP BY GROUPING SETS ((stream), ())")
def m2(t):
    """All, done and left, in rows and in pages of ten, for each stream and over all."""
    done = t.offerings.where("ranking > 45").select("course_id").distinct().withColumn("done", F.lit(True))
    c = t.courses.join(done, "course_id", "left").withColumn("done", F.coalesce("done", F.lit(False))).withColumn("pages", F.expr("(college_count + 9) div 10"))
    out = c.rollup("stream").agg(n(), F.sum("college_count").alias("expected"), F.sum("pages").alias("pages"), F.count_if("done").alias("done"), F.coalesce(F.sum(F.when(~F.col("done"), F.col("pages"))), F.lit(0)).alias("pages_left"))
    return out.withColumn("stream", F.coalesce("stream", F.lit("all")))


@query("M3_to_enrich", "SELECT d.college_id FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id WHERE (p.updated_at IS NULL OR p.updated_at < TIMESTAMP '1997-06-01 00:00:00') AND coalesce(d.website, '') <> '' ORDER BY d.college_id LIMIT 500")
def m3(t):
    """Never enriched or stale, with a link."""
    due = F.col("updated_at").isNull() | (F.col("updated_at") < F.lit(STALE))
    return t.directory.join(t.progress, "college_id", "left").where(due & ~X.missing(F.col("website"))).select("college_id").orderBy("college_id").limit(500)


@query("M4_deep_queue", "SELECT d.college_id, coalesce(m, 0) AS offers FROM directory d JOIN progress p ON p.college_id = d.college_id AND p.status = 'done' LEFT JOIN (SELECT college_id, count(*) AS m FROM offerings GROUP BY college_id) o ON o.college_id = d.college_id WHERE d.college_id NOT IN (SELECT college_id FROM progress WHERE found > 14) ORDER BY offers DESC, d.college_id LIMIT 300")
def m4(t):
    """Details done, own pass not ended, most offerings first."""
    ended = t.progress.where("found > 14").select("college_id", F.lit("gone").alias("status"))
    q = R.pending(t.directory, ended, "college_id", ("done", "gone")).join(t.progress.where("status = 'done'"), "college_id", "left_semi")
    counts = t.offerings.groupBy("college_id").agg(n("m"))
    return q.join(counts, "college_id", "left").select("college_id", F.coalesce("m", F.lit(0)).alias("offers")).orderBy(F.desc("offers"), "college_id").limit(300)


@query("M5_programme_queue", "SELECT c.course_id FROM courses c WHERE c.name <> '' AND c.course_id NOT IN (SELECT course_id FROM offerings WHERE ranking > 48 AND course_id IS NOT NULL) AND c.level NOT IN ('') AND EXISTS (SELECT 1 FROM offerings o WHERE o.course_id = c.course_id AND o.rating = 0)")
def m5(t):
    """With a name, not done, not to be skipped, and some value missing."""
    q = t.courses.where("name <> '' and level <> ''").join(t.offerings.where("ranking > 48"), "course_id", "left_anti")
    return q.join(t.offerings.where("rating = 0"), "course_id", "left_semi").select("course_id")


@query("M7_gap_queued", "SELECT p.college_id, p.status FROM progress p UNION ALL SELECT d.college_id, 'queued' FROM directory d WHERE d.college_id NOT IN (SELECT college_id FROM colleges) AND d.college_id NOT IN (SELECT college_id FROM progress)")
def m7(t):
    """Directory rows without a college join the queue, unless they are in it already."""
    gap = t.directory.join(t.colleges, "college_id", "left_anti").join(t.progress, "college_id", "left_anti")
    return t.progress.select("college_id", "status").union(gap.select("college_id", F.lit("queued")))


@query("M9_progress_written", "SELECT coalesce(p.college_id, s.college_id) AS college_id, CASE WHEN s.college_id IS NULL THEN p.status WHEN s.m > 0 THEN 'done' ELSE 'empty' END AS status, CASE WHEN s.college_id IS NULL THEN p.found ELSE s.m END AS found FROM progress p FULL OUTER JOIN (SELECT c.college_id, coalesce(m, 0) AS m FROM colleges c LEFT JOIN (SELECT college_id, count(*) AS m FROM offerings WHERE ranking > 49 GROUP BY college_id) o ON o.college_id = c.college_id) s ON s.college_id = p.college_id")
def m9(t):
    """What a pass has found, written over the progress table."""
    from ..operators import merge

    found = t.offerings.where("ranking > 49").groupBy("college_id").agg(n("m"))
    rows = t.colleges.select("college_id").join(found, "college_id", "left").select("college_id", F.when(F.col("m") > 0, "done").otherwise("empty").alias("status"), F.coalesce("m", F.lit(0)).alias("found"))
    return merge.upsert(t.progress.select("college_id", "status", "found"), rows, ["college_id"])


@query("M10_done_sets", "SELECT status, college_id FROM progress WHERE status IN ('done', 'empty')")
def m10(t):
    return t.progress.where(F.col("status").isin("done", "empty")).select("status", "college_id")


BACKLOG = (
    ("colleges website", "colleges", "coalesce(website, '') = ''"), ("colleges phone", "colleges", "coalesce(phone, '') = ''"), ("directory website", "directory", "coalesce(website, '') = ''"),
    ("directory phone", "directory", "coalesce(phone, '') = ''"), ("courses level", "courses", "level = ''"), ("offerings rating", "offerings", "rating = 0"), ("progress", "progress", "status = 'error'"),
)


@query("M11_backlog", " UNION ALL ".join(f"SELECT '{what}' AS what, count(*) AS total, count(*) FILTER (WHERE {rule}) AS pending FROM {table}" for what, table, rule in BACKLOG))
def m11(t):
    return reduce(DataFrame.union, (getattr(t, table).agg(F.lit(what).alias("what"), n("total"), F.count_if(F.expr(rule)).alias("pending")) for what, table, rule in BACKLOG))


# ---- panels (S) ----


@query("S1_recently_enriched", "SELECT college_id, status, updated_at FROM progress WHERE status <> 'error' ORDER BY updated_at DESC, college_id LIMIT 200")
def s1(t):
    return t.progress.where("status <> 'error'").select("college_id", "status", "updated_at").orderBy(F.desc("updated_at"), "college_id").limit(200)


@query("S3_phase_counters", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'empty') AS empty, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(found) AS BIGINT) AS found, max(updated_at) AS newest FROM progress")
def s3(t):
    of = lambda s: F.count_if(F.col("status") == s)
    return t.progress.agg(n("total"), of("done").alias("done"), of("empty").alias("empty"), of("error").alias("errors"), F.sum("found").alias("found"), F.max("updated_at").alias("newest"))


@query("S4_known_ids", "SELECT DISTINCT course_id FROM offerings WHERE fees_amount > 50000")
def s4(t):
    return t.offerings.where("fees_amount > 50000").select("course_id").distinct()


@query("S5_bridged_status", "SELECT count(*) AS n, count(p.college_id) FILTER (WHERE p.status IN ('done', 'empty')) AS done, CAST(coalesce(sum(o.m), 0) AS BIGINT) AS offers FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id LEFT JOIN (SELECT college_id, count(*) AS m FROM offerings GROUP BY college_id) o ON o.college_id = d.college_id WHERE d.college_id IN (SELECT college_id FROM colleges)")
def s5(t):
    bridged = t.directory.join(t.colleges, "college_id", "left_semi").join(t.progress.select("college_id", "status"), "college_id", "left")
    counts = t.offerings.groupBy("college_id").agg(n("m"))
    return bridged.join(counts, "college_id", "left").agg(n(), F.count_if(F.col("status").isin("done", "empty")).alias("done"), F.coalesce(F.sum("m"), F.lit(0)).alias("offers"))


@query("S6_largest_hosts", f"SELECT host, count(*) AS pages, CAST(sum(size) AS BIGINT) AS size FROM {HOSTS} GROUP BY host ORDER BY pages DESC, host LIMIT 20")
def s6(t):
    return hosts(t).groupBy("host").agg(n("pages"), F.sum("size").alias("size")).orderBy(F.desc("pages"), "host").limit(20)


@query("S7_catalogue_listing", "SELECT table_name, column_name FROM (VALUES ('colleges','college_id'),('colleges','name'),('colleges','city'),('colleges','state_id'),('colleges','rating'),('colleges','website'),('colleges','phone'),('progress','college_id'),('progress','status'),('progress','found'),('progress','updated_at')) AS x(table_name, column_name) WHERE (SELECT count(*) FROM colleges) >= 0")
def s7(t):
    """Tables and their columns, of those that are there."""
    one = lambda name: getattr(t, name).limit(1).select(F.lit(name).alias("table_name"), F.explode(F.array(*map(F.lit, getattr(t, name).columns))).alias("column_name"))
    return one("colleges").union(one("progress"))


@query("S8_backfill_dry_run", "SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(c.website, '') = '' AND coalesce(d.website, '') <> '') AS website, count(*) FILTER (WHERE coalesce(c.phone, '') = '' AND coalesce(d.phone, '') <> '') AS phone FROM colleges c JOIN directory d ON d.college_id = c.college_id")
def s8(t):
    """How many blanks a fill from the directory would close."""
    d = t.directory.select("college_id", F.col("website").alias("w"), F.col("phone").alias("p"))
    gain = lambda a, b: F.count_if(X.missing(F.col(a)) & ~X.missing(F.col(b)))
    return t.colleges.join(d, "college_id").agg(n(), gain("website", "w").alias("website"), gain("phone", "p").alias("phone"))


@query("S9_slugs_and_names", r"SELECT course_id, name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '(^-)|(-$)', '', 'g') AS slug FROM courses WHERE name <> ''")
def s9(t):
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "(^-)|(-$)", "")
    return t.courses.where("name <> ''").select("course_id", "name", slug.alias("slug"))


@query("S12_why_stopped", "SELECT job_id, last_work, last_level, CASE WHEN errors * 2 > m THEN 'failing' WHEN last_level = 'error' THEN 'ended in error' WHEN last_work < (SELECT max(ts) FROM logs) - INTERVAL 2 DAY THEN 'stalled' ELSE 'running' END AS verdict FROM (SELECT job_id, max(ts) AS last_work, arg_max(level, {'ts': ts, 'id': id}) AS last_level, count(*) AS m, count(*) FILTER (WHERE level = 'error') AS errors FROM logs GROUP BY job_id)")
def s12(t):
    newest = F.broadcast(t.logs.agg(F.max("ts").alias("newest")))  # one row
    jobs = t.logs.groupBy("job_id").agg(F.max("ts").alias("last_work"), F.max_by("level", F.struct("ts", "id")).alias("last_level"), n("m"), F.count_if(F.col("level") == "error").alias("errors")).join(newest)
    verdict = F.when(F.col("errors") * 2 > F.col("m"), "failing").when(F.col("last_level") == "error", "ended in error").when(F.col("last_work") < F.col("newest") - F.expr("INTERVAL 2 DAY"), "stalled").otherwise("running")
    return jobs.select("job_id", "last_work", "last_level", verdict.alias("verdict"))


@query("S13_probe_college", "SELECT college_id, name FROM directory WHERE name LIKE '%7%' ORDER BY length(name), college_id LIMIT 1")
def s13(t):
    return t.directory.where(F.col("name").like("%7%")).select("college_id", "name").orderBy(F.length("name"), "college_id").limit(1)


# ---- completed reports (O, N, A) ----


@query("O1_incomplete_columns", "SELECT column_name, CAST(filled AS BIGINT) AS filled, total, round(100.0 * filled / total, 2) AS percent FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(nullif({c}, '')) AS filled, count(*) AS total FROM directory" for c in ("website", "phone", "city", "name", "ownership")) + ") WHERE 100.0 * filled / total < 99.5 ORDER BY filled, column_name")
def o1(t):
    """Columns that are less than 99.5 % filled, emptiest first."""
    return R.completeness(t.directory, ["website", "phone", "city", "name", "ownership"]).select("column_name", "filled", "total", "percent").where(100.0 * F.col("filled") < 99.5 * F.col("total")).orderBy("filled", "column_name")


GAPS = (
    ("courses never offered", "courses", "offerings", "course_id", ""), ("courses never ranked", "courses", "offerings", "course_id", "ranking > 40"), ("courses never rated", "courses", "offerings", "course_id", "rating > 45"),
    ("colleges without offerings", "colleges", "offerings", "college_id", ""), ("colleges without top ranks", "colleges", "offerings", "college_id", "ranking = 1"), ("colleges without dear offerings", "colleges", "offerings", "college_id", "fees_amount > 95000"),
    ("directory without college", "directory", "colleges", "college_id", ""), ("directory without progress", "directory", "progress", "college_id", ""), ("directory not done", "directory", "progress", "college_id", "status = 'done'"),
    ("directory not found", "directory", "progress", "college_id", "found > 8"), ("progress without directory", "progress", "directory", "college_id", ""), ("offerings without course", "offerings", "courses", "course_id", "level <> ''"),
    ("offerings without college", "offerings", "colleges", "college_id", "website <> ''"),
)


@query("O2_thirteen_gaps", probes_sql(*((what, f"{a} WHERE {key} NOT IN (SELECT {key} FROM {b}{' WHERE ' + rule if rule else ''})") for what, a, b, key, rule in GAPS)))
def o2(t):
    return probes(*((what, getattr(t, a).join(getattr(t, b).where(rule or "true").select(key), key, "left_anti")) for what, a, b, key, rule in GAPS))


@query("N14_partition_check", "SELECT state_id, bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY state_id), 2) AS percent, CAST(sum(count(*)) OVER () AS BIGINT) = (SELECT count(*) FROM directory) AS whole FROM (SELECT d.state_id, CASE WHEN p.found > 10 THEN 'yes' WHEN p.found > 5 THEN 'pending' ELSE 'none' END AS bucket FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id) GROUP BY state_id, bucket")
def n14(t):
    """Three buckets of the gap by state; together they must be the directory."""
    bucket = F.when(F.col("found") > 10, "yes").when(F.col("found") > 5, "pending").otherwise("none")
    g = t.directory.join(t.progress, "college_id", "left").groupBy("state_id", bucket.alias("bucket")).agg(n())
    total = F.broadcast(t.directory.agg(n("_total")))  # one row
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("state_id")), 2)
    return g.withColumn("percent", share).withColumn("_all", F.sum("n").over(Window.partitionBy())).join(total).select("state_id", "bucket", "n", "percent", (F.col("_all") == F.col("_total")).alias("whole"))
