"""Registered queries of the wide record projections; the records are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as W
from .catalogue import n, query


def parsed(df, key, body):
    return df.select(key, F.try_parse_json(F.to_json(body)).alias("v"))


@query("C2_programmes", """SELECT p_partkey AS program_id, p_name AS name, '' AS name_secondary, p_size * 12 AS duration_months, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS is_stem, 'USD' AS fee_currency, CAST(p_size * 1000 AS BIGINT) AS fee_native_amount,
 CAST(p_size * 100000 AS BIGINT) AS fee_inr_amount, 'per_year' AS fee_period, 'usa' AS country_code, concat('https://host.example/usa/university/', p_partkey) AS university_url, '' AS logo_url, CASE WHEN p_size > 25 THEN CAST(p_size AS BIGINT) END AS ranking_rank, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS ranking_agency FROM part""")
def programmes(t):
    some = F.col("p_size") > 25
    body = F.struct(
        F.col("p_partkey").cast("string").alias("course_id"), F.col("p_name").alias("head_one"), F.concat("p_size", F.lit(" Years")).alias("course_duration"),
        (F.col("p_size") % 2 == 0).alias("is_stem"), F.concat(F.lit("USD "), "p_size", F.lit(",000")).alias("default_fee_per_year"), F.concat(F.lit("₹ "), "p_size", F.lit(" Lakhs")).alias("total_fee_per_year"),
        F.concat(F.lit("/usa/university/"), "p_partkey").alias("college_url"), F.when(some, F.struct(F.col("p_size").alias("rank"), F.col("p_brand").alias("agencyShortForm"))).alias("ranking"),
    )
    out = W.programme_rows(parsed(t.read("part"), "p_partkey", body), "https://host.example")
    return out.select("program_id", "name", "name_secondary", "duration_months", "is_stem", "fee_currency", "fee_native_amount", "fee_inr_amount", "fee_period", "country_code", "university_url", "logo_url", "ranking_rank", "ranking_agency")


@query("C2_universities", """SELECT name, city, state_id, city AS country_name, coalesce(website, '') AS website, coalesce(phone, '') AS phone, rating AS avg_rating FROM colleges""")
def universities(t):
    head = F.struct(F.col("name").alias("college"), "city", F.col("state_id").cast("string").alias("state_id"), F.lit("").alias("country"))
    body = F.struct(F.struct(head.alias("head")).alias("basic_info"), F.col("city").alias("country_name"), F.struct("website", F.col("phone").alias("contact")).alias("contact_location"), F.struct(F.col("rating").alias("average_rating")).alias("review_stats"))
    found = parsed(t.colleges, "college_id", body).select(*W.project(F.col("v"), W.UNIVERSITY))
    return found.select("name", "city", "state_id", "country_name", "website", "phone", "avg_rating")


@query("C3_college_rows", """SELECT college_id, name, city, state_id, coalesce(website, '') AS website, phone, rating, '["Lab","Library & hall"]' AS facilities, '["courses","fees"]' AS tab_urls, concat('About ', name) AS admission_text,
 CASE WHEN college_id % 2 = 0 THEN '' ELSE concat('Founded in ', city) END AS description, '' AS accepted_exams, CAST(NULL AS DOUBLE) AS latitude FROM colleges""")
def college_rows(t):
    c = F.col
    contact = F.struct(c("website").alias("website_url"), F.lit("").alias("admission_contact_number"), c("phone").alias("generic_contact_number"))
    told = F.when(c("college_id") % 2 == 0, F.concat(F.lit("<p>About "), "name", F.lit("</p>"))).otherwise(F.concat(F.lit("Founded&nbsp;in <b>"), "city", F.lit("</b>")))
    body = F.struct(
        c("college_id").cast("string").alias("listingId"), F.struct(F.struct(c("rating").alias("averageRating")).alias("reviewDetails")).alias("instituteTopCardData"), c("name").alias("listingName"),
        F.struct(c("city").alias("city_name"), c("state_id"), contact.alias("contact_details")).alias("currentLocation"),
        F.array(*(F.struct(F.lit(x).alias("facilityName")) for x in ("Lab", "", "Library & hall"))).alias("facilityInfo"),
        F.create_map(F.lit("fees"), F.lit("/f"), F.lit("courses"), F.lit("/c")).alias("childPageToUrls"),
        F.struct(F.concat(F.lit("<p>About</p> "), "name").alias("admissionDetails")).alias("admissionData"), told.alias("description"),
    )
    out = W.college_rows(parsed(t.colleges, "college_id", body))
    return out.select("college_id", "name", "city", "state_id", "website", "phone", "rating", "facilities", "tab_urls", "admission_text", "description", "accepted_exams", "latitude")


@query("C3_listing_rows", """SELECT page, college_id, course_id, concat('Course ', course_id, ' & more') AS course_name, fees_amount, rating, CASE WHEN ranking % 2 = 0 THEN '2 years' ELSE '2-3 years' END AS duration, concat('["E', source_job_id % 3, '"]') AS exams, CASE WHEN ranking > 20 THEN 1 ELSE 0 END AS is_online,
 concat('c-', course_id) AS course_slug, '' AS skills, CAST(NULL AS BIGINT) AS total_seats FROM (SELECT *, row_number() OVER (PARTITION BY page, course_id ORDER BY id, fees_amount) AS r FROM (SELECT *, id // 10 AS page, first_value(college_id) OVER (PARTITION BY id // 10 ORDER BY id, college_id) AS own FROM offerings) WHERE college_id = own) WHERE r = 1""")
def listing_rows(t):
    """A page for each order; its college is that of the first line, lines of others are foreign cards."""
    c = F.col
    card = F.struct(
        c("course_id").cast("string").alias("courseId"), c("college_id").alias("instituteId"), F.concat(F.lit("Course <b>"), "course_id", F.lit("</b> &amp; more")).alias("name"), F.concat(F.lit("/x/c-"), "course_id").alias("url"),
        F.concat(F.floor(c("fees_amount") / 1000), F.lit(","), F.lpad((c("fees_amount") % 1000).cast("string"), 3, "0")).alias("fees"), c("rating").alias("courseRating"),
        F.lit(2).alias("duration"), (c("ranking") % 2 + 2).alias("maxDuration"), F.lit("years").alias("durationUnit"),
        F.array(F.struct(F.concat(F.lit("E"), c("source_job_id") % 3).alias("examName"))).alias("exams"), (c("ranking") > 20).alias("isOnline"),
    )
    cards = t.offerings.select(F.floor(c("id") / 10).alias("page"), F.struct("id", "college_id", "course_id", "fees_amount", card.alias("card")).alias("line"))
    pages = cards.groupBy("page").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    body = F.struct(F.get("lines", F.lit(0))["college_id"].alias("listingId"), F.transform("lines", lambda x: x["card"]).alias("courseTuples"))
    out = W.listing_rows(parsed(pages, "page", body), "page")
    return out.select("page", "college_id", "course_id", "course_name", "fees_amount", "rating", "duration", "exams", "is_online", "course_slug", "skills", "total_seats")


@query("C3_detail_rows", """SELECT course_id, name AS course_name, college_count * 1000 AS fees_total, concat('{"general":{"unit":"INR","value":', college_count * 1000, '}}') AS fees_total_json, '' AS fees_hostel_json, '["Apply","Sit","Join"]' AS admission_steps, CASE WHEN level = '' THEN NULL WHEN level = 'UG' THEN 1 ELSE 0 END AS internships_available,
 concat(college_count, ' months') AS duration, college_count AS elig_xii_general, '["English","Hindi"]' AS medium, college_count % 9 AS stream_id, level AS course_level FROM courses""")
def detail_rows(t):
    c = F.col
    body = F.struct(
        "course_id", c("name").alias("courseName"), c("course_id").alias("courseId"), c("college_count").alias("durationValue"), F.lit("months").alias("durationUnit"),
        F.struct(F.array(F.struct((c("college_count") % 9).alias("stream_id"))).alias("hierarchy"), F.struct(c("level").alias("name")).alias("course_level")).alias("entryCourseTypeInformation"),
        F.struct(F.struct(F.struct(F.struct((c("college_count") * 1000).alias("value"), F.lit("INR").alias("unit")).alias("general")).alias("totalFees"), F.from_json(F.lit("{}"), "map<string,string>").alias("hostelFees")).alias("fees")).alias("courseFees"),
        F.struct(F.struct(F.struct(F.struct(c("college_count").alias("score")).alias("general")).alias("categoryWiseScores")).alias("twelthDetails")).alias("eligibility"),
        F.create_map(F.lit("10"), F.lit("Join"), F.lit("1"), F.lit("Apply"), F.lit("2"), F.lit("Sit")).alias("admissionProcess"),
        F.struct(F.when(c("level") != "", c("level") == "UG").alias("is_internship_available")).alias("placements"), F.array(F.lit("English"), F.lit("Hindi")).alias("mediumOfInstruction"),
    )
    out = W.detail_rows(parsed(t.courses, "course_id", body))
    return out.select("course_id", "course_name", "fees_total", "fees_total_json", "fees_hostel_json", "admission_steps", "internships_available", "duration", "elig_xii_general", "medium", "stream_id", "course_level")


@query("C2_rankings", """SELECT college_id, a AS agency_id, CASE a WHEN 1 THEN 'One' WHEN 2 THEN 'Two' ELSE '' END AS agency, 2020 + y AS year, stream, CASE WHEN stream = 'Overall' THEN college_id + y END AS rank, CASE WHEN stream = 'Overall' THEN 'world' ELSE '' END AS scope
 FROM colleges, (VALUES (1, 0), (2, 0), (3, 1)) AS e(a, y), (VALUES ('Overall'), ('Law')) AS s(stream)""")
def rankings(t):
    """Agencies, years and streams; a year holds a list or one entry, and one agency has no name."""
    i = F.col("college_id").cast("string")
    entry = lambda a, y: F.concat(F.lit(f'{{"agencyId": {a}, "year": "{2020 + y}", "stream": {{"uni": {{"Overall": {{"rank": '), (F.col("college_id") + y).cast("string"), F.lit(', "scope": "world"}, "Law": {}, "Bad": 7}}}'))
    years = F.concat(F.lit('{"2020": ['), entry(1, 0), F.lit(", 5, "), entry(2, 0), F.lit('], "2021": '), entry(3, 1), F.lit("}"))
    body = F.concat(F.lit('{"id": '), i, F.lit(', "ranking_data": {"agencies": {"1": {"name": "One"}, "2": {"name": "Two"}}, "year_wise_data": '), years, F.lit("}}"))
    out = W.ranking_rows(t.colleges.select("college_id", F.try_parse_json(body).alias("v")), ["college_id"], "uni")
    return out.select("college_id", "agency_id", "agency", "year", "stream", "rank", "scope")


@query("C2_costs_and_places", """SELECT college_id, 'hostel' AS kind, 'Room' AS label, CAST(state_id AS VARCHAR) AS value FROM colleges UNION ALL SELECT college_id, 'hostel', 'Board', '' FROM colleges UNION ALL SELECT college_id, 'airport', city, '7.5' FROM colleges WHERE college_id % 2 = 0""")
def costs_and_places(t):
    """Lists under keys: costs of living and what is near; items without a label are passed over."""
    one = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    cost = F.create_map(F.lit("hostel"), F.array(one("Room", F.col("state_id")), one("Board", F.lit(None)), one("", F.lit(1))))
    near = F.create_map(F.lit("airport"), F.when(F.col("college_id") % 2 == 0, F.array(F.struct(F.col("city").alias("name"), F.lit(7.5).alias("distance")))))
    df = parsed(t.colleges, "college_id", F.struct(cost.alias("accommodation_data"), near.alias("nearby")))
    costs = W.keyed_rows(df, ["college_id"], "$.accommodation_data", "kind", "label raw label\nvalue raw value").where("label <> ''")
    return costs.unionByName(W.keyed_rows(df, ["college_id"], "$.nearby", "kind", "label raw name\nvalue raw distance").where("label <> ''"))


@query("C2_exam_scores", "SELECT course_id, 'GRE' AS short_form, CAST(college_count AS VARCHAR) AS exam_score, '340' AS out_of FROM courses UNION ALL SELECT course_id, 'IELTS', '', '9' FROM courses WHERE course_id % 3 = 0")
def exam_scores(t):
    one = F.struct(F.lit("GRE").alias("short_form"), F.col("college_count").cast("string").alias("exam_score"), F.lit("340").alias("exam_out_of_score"))
    two = F.struct(F.when(F.col("course_id") % 3 == 0, "IELTS").alias("short_form"), F.lit("").alias("exam_score"), F.lit("9").alias("exam_out_of_score"))
    df = parsed(t.courses, "course_id", F.struct(F.array(one, two).alias("exam_data")))
    return W.child_rows(df, ["course_id"], "$.exam_data", W.EXAM_SCORE).where("short_form <> ''")


@query("C2_scholarships", "SELECT p_partkey AS scholarship_id, p_name AS name, CAST(p_size AS BIGINT) * 1000 AS inr, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) * 10 END AS amount, CASE WHEN p_size % 2 = 0 THEN 'EUR' END AS currency FROM part")
def scholarships(t):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("₹"), size, F.lit(",000"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" (€ "), size, F.lit("0)"))).otherwise(""))
    df = parsed(t.read("part"), "p_partkey", F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), text.alias("amount")))
    out = df.select(*W.project(F.col("v"), "scholarship_id int id\nname text title name\nraw_amount raw amount"))
    inr, amount, currency = W.scholarship_amount(F.col("raw_amount"))
    return out.select("scholarship_id", "name", inr.alias("inr"), amount.alias("amount"), currency.alias("currency"))


BASE_COURSES = "(SELECT college_id, course_id, min(fees_amount) AS low, max(fees_amount) AS high, count(*) AS m FROM offerings GROUP BY college_id, course_id)"


@query("C3_base_courses", f"SELECT college_id, course_id AS base_course_id, concat('Course ', CAST(course_id AS VARCHAR)) AS name, low AS min_fees, high AS max_fees, m AS course_count, '[\"E\"]' AS exams FROM {BASE_COURSES}")
def base_courses(t):
    """The fees table of a college page: one row for each base course; repeated tuples and such without an id go."""
    g = t.offerings.groupBy("college_id", "course_id").agg(F.min("fees_amount").alias("low"), F.max("fees_amount").alias("high"), n("m"))
    one = F.struct(F.col("course_id").cast("string").alias("id"), F.concat(F.lit("<i>Course</i> "), "course_id").alias("name"), F.col("low").alias("minFees"), F.col("high").alias("maxFees"), F.col("m").alias("courseCount"), F.array(F.struct(F.lit("E").alias("examName"))).alias("exams"))
    pages = g.groupBy("college_id").agg(F.collect_list(one).alias("xs"))
    body = F.struct(F.concat("xs", F.slice("xs", 1, 2), F.transform(F.slice("xs", 1, 1), lambda x: x.withField("id", F.lit("none")))).alias("baseCourseTuples"))
    out = W.base_course_rows(parsed(pages, "college_id", body), "college_id")
    return out.select("college_id", "base_course_id", "name", "min_fees", "max_fees", "course_count", "exams")


@query("C3_course_catalogue", f"SELECT course_id AS base_course_id, concat('Course ', CAST(course_id AS VARCHAR)) AS name, count(*) AS colleges FROM {BASE_COURSES} GROUP BY course_id")
def course_catalogue(t):
    """The shared catalogue, from the base courses of all colleges."""
    return base_courses(t).groupBy("base_course_id", "name").agg(n("colleges"))
