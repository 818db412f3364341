"""Registered queries of gap profiles, label matching, quality counters, job scores, and sitemaps read as XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import gaps as G
from ..sources import pages as P
from ..streaming.folders import scratch
from .catalogue import n, query

SIDE = "CASE WHEN p.status IN ('done', 'empty') THEN 'matched' WHEN p.status = 'error' THEN 'pending' ELSE 'none' END"
GAP = f"""SELECT d.college_id, d.ownership, d.city, {SIDE} AS bucket, CASE WHEN d.college_id % 13 = 0 THEN 'many' ELSE CAST(d.college_id % 12 - 1 AS STRING) END AS base_courses,
 CASE WHEN d.college_id % 9 = 0 THEN NULL WHEN d.college_id % 50 = 7 THEN 'some' ELSE CAST(d.college_id % 40 AS STRING) END AS reviews FROM {{directory}} d LEFT JOIN {{progress}} p ON p.college_id = d.college_id"""
SQL_GAP = f"g AS ({GAP.format(directory='directory', progress='progress')})"
SHARES = "*, round(100.0 * matched / greatest(sum(matched) OVER w, 1), 1) AS matched_share, round(100.0 * pending / greatest(sum(pending) OVER w, 1), 1) AS pending_share, round(100.0 * \"none\" / greatest(sum(\"none\") OVER w, 1), 1) AS none_share"
COUNTS = "section, value, count(*) AS seen, count(*) FILTER (WHERE bucket = 'matched') AS matched, count(*) FILTER (WHERE bucket = 'pending') AS pending, count(*) FILTER (WHERE bucket = 'none') AS \"none\""


def gap(t):
    return t.spark.sql(GAP, directory=t.directory, progress=t.progress)


@query("N14_cross_tables", f"""WITH {SQL_GAP}, c AS (SELECT 'ownership' AS section, coalesce(nullif(trim(ownership), ''), '(blank)') AS value, bucket FROM g UNION ALL SELECT 'city', coalesce(nullif(trim(city), ''), '(blank)'), bucket FROM g
 UNION ALL SELECT 'base courses', CASE WHEN TRY_CAST(base_courses AS INT) IS NULL THEN '(unknown)' WHEN CAST(base_courses AS INT) <= 0 THEN '0 base courses' WHEN CAST(base_courses AS INT) = 1 THEN '1' WHEN CAST(base_courses AS INT) <= 3 THEN '2-3' WHEN CAST(base_courses AS INT) <= 9 THEN '4-9' ELSE '10+' END, bucket FROM g
 UNION ALL SELECT 'reviews', CASE WHEN reviews IS NULL OR reviews = '0' THEN 'no reviews' WHEN TRY_CAST(reviews AS INT) IS NULL THEN '(unknown)' WHEN CAST(reviews AS INT) <= 5 THEN '1-5' WHEN CAST(reviews AS INT) <= 25 THEN '6-25' ELSE '26+' END, bucket FROM g),
 k AS (SELECT {COUNTS} FROM c GROUP BY section, value), s AS (SELECT {SHARES}, row_number() OVER (PARTITION BY section ORDER BY seen DESC, value) AS place FROM k WINDOW w AS (PARTITION BY section)) SELECT * EXCLUDE (place) FROM s WHERE section <> 'city' OR place <= 12""")
def cross(t):
    """What kinds of colleges are matched, pending and without a partner: ownership, the 12 largest cities, sizes and reviews."""
    sections = {"ownership": G.named(F.col("ownership")), "city": G.named(F.col("city")), "base courses": G.size_bucket(F.col("base_courses")), "reviews": G.review_bucket(F.col("reviews"))}
    return G.cross_tables(gap(t), sections, top={"city": 12})


@query("N14_base_course_mix", f"""WITH {SQL_GAP}, b AS (SELECT DISTINCT o.college_id, c.stream AS value FROM offerings o JOIN courses c ON c.course_id = o.course_id WHERE c.stream <> ''), c AS (SELECT 'base course' AS section, value, bucket FROM b JOIN g ON g.college_id = b.college_id),
 k AS (SELECT {COUNTS} FROM c GROUP BY section, value), s AS (SELECT {SHARES}, row_number() OVER (ORDER BY seen DESC, value) AS place FROM k WINDOW w AS (PARTITION BY section)) SELECT * EXCLUDE (place) FROM s WHERE place <= 12""")
def mix(t):
    """The twelve base courses that most colleges offer, by gap."""
    base = t.offerings.select("college_id", "course_id").distinct().join(t.courses.select("course_id", "stream"), "course_id")
    return G.taught(gap(t), base, "college_id", "stream")


SLUG = "concat(CASE college_id % 6 WHEN 0 THEN 'govt-ITI' WHEN 1 THEN 'national-institute-college' WHEN 2 THEN 'city-college' WHEN 3 THEN 'university-school' WHEN 4 THEN 'home' ELSE 'polytechnic-academy' END, '-', CAST(college_id AS STRING))"


@query("N13_keyword_profile", f"""WITH x AS (SELECT CASE WHEN {SIDE} = 'matched' THEN 'matched' ELSE 'only' END AS side, lower({SLUG.replace('college_id', 'd.college_id')}) AS slug, NOT EXISTS (SELECT 1 FROM offerings o WHERE o.college_id = d.college_id) AS empty FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id),
 y AS (SELECT side, {'CASE ' + ' '.join(f"WHEN contains(slug, '{k}') THEN '{k}'" for k in G.KINDS)} ELSE '(other)' END AS kind, empty FROM x), z AS (SELECT side, count(*) AS rows_n FROM y GROUP BY side)
 SELECT side, kind, n, round(100.0 * n / rows_n, 1) AS percent FROM (SELECT side, kind, count(*) AS n FROM y GROUP BY side, kind UNION ALL SELECT side, 'no offerings', count(*) FILTER (WHERE empty) FROM y GROUP BY side) JOIN z USING (side)""")
def keyword_profile(t):
    """Kinds of institutions by their address, among those that have a partner and those that don't."""
    g = gap(t).select("college_id", "bucket", F.expr(SLUG).alias("slug"))
    offers = t.offerings.select("college_id").distinct().withColumn("offers", F.lit(True))
    return G.slug_profile(g.join(offers, "college_id", "left"), "slug", F.col("bucket") == "matched", F.col("offers").isNull())


#: Other names of countries, by the letters of their codes.
ALIASES = {
    "usa": ("united states", "united states of america", "us", "usa", "america"), "uk": ("united kingdom", "uk", "great britain", "britain", "england"),
    "uae": ("united arab emirates", "uae"), "nz": ("new zealand",), "hongkong": ("hong kong",), "southkorea": ("south korea", "korea"), "srilanka": ("sri lanka",),
    "southafrica": ("south africa",), "czechrepublic": ("czech republic", "czechia"),
}
LABELS = ("United States", "Great Britain", "Hong Kong", "Korea", "Germany (East)", "Germany", "Czechia", "France", "Ireland", "Icel.", "france", "England")
CODES = ("usa", "uk", "hongkong", "southkorea", "germ", "czech-republic", "FRANCE", "ire", "irel", "icelandic", "nz", "")
CASES = lambda key, names: "CASE " + key + f" % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
FOLD = "regexp_replace(lower({}), '[^a-z]', '', 'g')"


@query("N15_three_stages", f"""WITH l AS (SELECT {CASES('c_custkey', LABELS)} AS label, min(c_custkey) AS value FROM customer GROUP BY 1), k AS (SELECT {FOLD.format('label')} AS k, arg_max(label, value) AS label, max(value) AS value, min(value) AS came FROM l GROUP BY 1),
 c AS (SELECT {CASES('s_suppkey', CODES)} AS code, count(*) AS n FROM supplier GROUP BY 1), m AS (SELECT *, {FOLD.format('code')} AS c FROM c), a(c, place, k) AS (VALUES {', '.join(f"('{c}', {i}, '{x.replace(' ', '')}')" for c, xs in ALIASES.items() for i, x in enumerate(xs))}),
 b AS (SELECT a.c, arg_min(k.label, a.place) AS label, arg_min(k.value, a.place) AS value FROM a JOIN k ON k.k = a.k GROUP BY a.c), s AS (SELECT m.c, arg_min(k.label, k.came) AS label, arg_min(k.value, k.came) AS value FROM m JOIN k ON length(m.c) >= 4 AND starts_with(k.k, m.c) GROUP BY m.c)
 SELECT m.code, m.n, coalesce(k.label, b.label, s.label) AS label, coalesce(k.value, b.value, s.value) AS value, CASE WHEN k.k IS NOT NULL THEN 'exact' WHEN b.c IS NOT NULL THEN 'alias' WHEN s.c IS NOT NULL THEN 'prefix' ELSE 'none' END AS stage FROM m LEFT JOIN k ON k.k = m.c LEFT JOIN b ON b.c = m.c LEFT JOIN s ON s.c = m.c""")
def three_stages(t):
    """Country codes to facet labels: by their letters, by other names, by the beginning."""
    labels = t.read("customer").groupBy(F.expr(CASES("c_custkey", LABELS)).alias("label")).agg(F.min("c_custkey").alias("value"))
    codes = t.read("supplier").groupBy(F.expr(CASES("s_suppkey", CODES)).alias("code")).agg(n())
    aliases = t.spark.createDataFrame([(c, i, x) for c, xs in ALIASES.items() for i, x in enumerate(xs)], "code string, place int, alias string")
    return codes.join(G.match_labels(codes.select("code"), labels, aliases), "code").select("code", "n", "label", "value", "stage")


@query("F20_seven_counters", """SELECT (SELECT count(*) FROM courses WHERE college_count IS NULL OR college_count % 10 = 0) AS courses_zero_colleges, (SELECT count(*) FROM offerings WHERE fees_amount IS NULL OR fees_amount < 1500) AS offerings_no_fee, (SELECT count(*) FROM offerings WHERE rating IS NULL OR rating = 0) AS offerings_no_rating,
 (SELECT count(*) FROM colleges WHERE city IS NULL OR city = '' OR website = '') AS colleges_no_city, (SELECT count(*) FROM colleges c LEFT JOIN progress p ON p.college_id = c.college_id WHERE p.updated_at IS NULL) AS colleges_unenriched, (SELECT count(*) FROM (SELECT name FROM courses WHERE name <> '' GROUP BY name HAVING count(*) > 1)) AS dup_college_names,
 (SELECT count(*) FROM directory WHERE ownership <> '' AND college_id % 3 = 0) AS cc_unparsed_fees""")
def seven(t):
    """The seven counters of the quality report: of each table one pass. Fees under 1,500 and tens of colleges stand for none."""
    none = lambda c: F.coalesce(c == 0, F.lit(True))
    courses = t.courses.select((F.col("college_count") % 10).alias("colleges_count"), "name")
    one = courses.agg(F.count_if(none(F.col("colleges_count"))).alias("courses_zero_colleges"))
    offers = t.offerings.select(F.when(F.col("fees_amount") >= 1500, F.col("fees_amount")).alias("fee"), "rating").agg(F.count_if(none(F.col("fee"))).alias("offerings_no_fee"), F.count_if(none(F.col("rating"))).alias("offerings_no_rating"))
    stamped = t.colleges.select("college_id", F.when(F.coalesce(F.col("website") != "", F.lit(True)), F.col("city")).alias("city")).join(t.progress.select("college_id", "updated_at"), "college_id", "left")
    colleges = stamped.agg(F.count_if(X.missing(F.col("city"))).alias("colleges_no_city"), F.count_if(F.col("updated_at").isNull()).alias("colleges_unenriched"))
    twice = courses.where("name <> ''").groupBy("name").agg(n()).where("n > 1").agg(n("dup_college_names"))
    fees = t.directory.select("ownership", X.fee_to_units(F.when(F.col("college_id") % 3 == 0, "on request").otherwise("1 Lakh")).alias("fees_inr")).agg(F.count_if(F.col("fees_inr").isNull() & (F.col("ownership") != "")).alias("cc_unparsed_fees"))
    return one.join(offers).join(colleges).join(twice).join(fees)  # single rows


@query("K3_scores_with_fallback", """WITH s AS (SELECT source_job_id AS job, 'staging' AS source, count(*) AS total, count(*) FILTER (WHERE fees_amount < 30000 OR id % 19 = 0) AS lost, count(*) FILTER (WHERE id % 11 = 0 OR id % 19 = 0) AS blanks FROM offerings WHERE source_job_id % 3 = 0 GROUP BY source_job_id),
 p AS (SELECT source_job_id AS job, 'promoted' AS source, count(*) AS total, count(*) FILTER (WHERE fees_amount < 2000) AS lost, count(*) FILTER (WHERE id % 7 = 0) AS blanks FROM offerings WHERE source_job_id % 3 <> 0 OR source_job_id < 6 GROUP BY source_job_id HAVING source_job_id NOT IN (SELECT job FROM s)), u AS (SELECT * FROM s UNION ALL SELECT * FROM p)
 SELECT job, source, total, missing_percent, blanks, score, total >= 200 AND score >= 70 AS passed FROM (SELECT *, round(100.0 * lost / total, 1) AS missing_percent, round(greatest(0, 100 - CASE WHEN total < 200 THEN 50 ELSE 0 END - least(40.0, greatest(0.0, 100.0 * lost / total - 30.0)) - least(20.0, blanks)), 1) AS score FROM u)""")
def fallback(t):
    """Scores of jobs by what is staged, or where that has been promoted already by the promoted rows."""
    o = t.offerings.select("id", "source_job_id", "fees_amount")
    payload = F.to_json(F.struct(F.when(F.col("fees_amount") >= 30000, F.col("fees_amount")).otherwise(0).alias("fees_amount"), F.when(F.col("id") % 11 == 0, "").otherwise("x").alias("course_name")))
    staged = o.where("source_job_id % 3 = 0").select(F.col("source_job_id").alias("job_id"), F.lit("offerings").alias("table_name"), F.when(F.col("id") % 19 == 0, "{broken").otherwise(payload).alias("payload"))
    master = o.where("source_job_id % 3 <> 0 OR source_job_id < 6").select("source_job_id", F.when(F.col("fees_amount") >= 2000, F.col("fees_amount")).alias("fees_amount"), F.when(F.col("id") % 7 == 0, "").otherwise("x").alias("course_name"))
    return G.job_scores(staged, {"offerings": master, "directory": t.directory}, 200, 30.0)


@query("A7_sitemaps_as_xml", r"""SELECT CASE page_id % 3 WHEN 0 THEN 'college' ELSE 'course' END AS family, url AS loc, CASE WHEN page_id % 2 = 0 THEN concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')) ELSE '' END AS lastmod FROM pages WHERE page_id % 3 <> 2""")
def xml(t):
    """Every page's address from sitemap files of up to 50; those of other families aren't read. Files with a bare ampersand are no
    XML: they are read leniently."""
    at = scratch(t.spark, "sitemaps")
    family = F.expr("CASE page_id % 3 WHEN 0 THEN 'college' WHEN 1 THEN 'course' ELSE 'news' END")
    part = F.expr("page_id div 50")
    loc = F.when(part % 3 == 1, F.col("url")).otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    date = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc> "), loc, F.lit(" </loc>"), date, F.lit("</url>"))
    maps = t.pages.groupBy(family.alias("family"), part.alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</urlset>")).alias("value"))
    maps.select("family", "value").write.partitionBy("family").option("maxRecordsPerFile", 1).text(f"{at}/maps")
    return P.sitemap_files(t.spark, [f"{at}/maps/family={f}" for f in ("college", "course")], f"{at}/maps")
