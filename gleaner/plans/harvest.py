"""Registered queries of extraction from harvested payloads, of scalar rules, and of what phases write.

The given tables hold no sitemaps, state objects, JSON-LD or HTML tables: the plans put the rows of a table into such
payloads, odd shapes among them, and read them back; the SQL says what must be found.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import payload as V
from ..functions import records as W
from ..functions import text as X
from ..operators import merge
from ..operators import relational as R
from ..sources import pages as P
from ..sources import sinks
from .catalogue import n, query


def by(value: str, *cases: str, last: str) -> Column:
    """The expression for each remainder of a key."""
    m = len(cases) + 1
    return F.expr("CASE " + " ".join(f"WHEN {value} % {m} = {i} THEN {c}" for i, c in enumerate(cases)) + f" ELSE {last} END")


# ---- sources (A, B) ----


@query("A4_slices_within", """WITH r AS (SELECT stream, course_type, level, name, count(*) AS n, grouping(course_type) + grouping(level) + grouping(name) AS open FROM courses GROUP BY ROLLUP (stream, course_type, level, name) HAVING grouping(stream) = 0)
 SELECT a.stream, a.course_type, a.level, a.name, a.n FROM r a LEFT JOIN r p ON p.open = a.open + 1 AND p.stream = a.stream AND (p.open > 2 OR p.course_type = a.course_type) AND (p.open > 1 OR p.level = a.level) WHERE (a.n <= 7 OR a.open = 0) AND (p.n IS NULL OR p.n > 7)
 UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FROM courses HAVING count(*) <= 7""")
def a4(t):
    """Four dimensions, as deep as a slice needs."""
    return R.slices_within(t.courses, ["stream", "course_type", "level", "name"], 7)


@query("A6_directory_from_two_parsers", "SELECT college_id, name, city, CASE WHEN college_id % 3 = 0 THEN 'page' ELSE 'json' END AS parser FROM directory WHERE college_id % 3 = 0 OR city IS NOT NULL")
def a6(t):
    """Partitions answer with JSON; where its key is absent, the page is read."""
    d = t.directory.withColumn("json", F.to_json(F.struct("college_id", "name", "city"))).withColumn("html", F.concat(F.lit("<h1>"), "name", F.lit("</h1><p class=\"city\">"), "city", F.lit("</p>")))
    answers = d.select("college_id", F.try_parse_json(F.when(F.col("college_id") % 3 == 0, F.lit('{"status": "moved"}')).otherwise(F.col("json"))).alias("v"), "html")
    rows = answers.select("college_id", *(V.field(F.col("v"), f"$.{c}", "string").alias(c) for c in ("name", "city")), "html")
    own = rows.where("name is not null").select("college_id", "name", "city", F.lit("json").alias("parser"))
    read = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    return own.unionByName(rows.where("name is null").select("college_id", read("<h1>(.*?)</h1>").alias("name"), read('<p class="city">(.*?)</p>').alias("city"), F.lit("page").alias("parser")))


def sitemaps(t):
    """A sitemap for each language; pages with an odd id have no date."""
    lang = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)/", 1)
    entry = F.concat(F.lit("<url>\n <loc> "), "url", F.lit(" </loc>"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    return t.pages.where("not contains(url, '&')").groupBy(lang.alias("lang")).agg(F.concat_ws("\n", F.collect_list(entry)).alias("xml"))


@query("A7_sitemap_entries", r"SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS lang, url AS loc, CASE WHEN page_id % 2 = 0 THEN concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')) ELSE '' END AS lastmod FROM pages WHERE NOT contains(url, '&')")
def a7(t):
    return P.sitemap_entries(sitemaps(t))


@query("A9_sitemap_families", "SELECT concat('https://x.example/', CASE page_id % 3 WHEN 0 THEN 'College' WHEN 1 THEN 'course' ELSE 'news' END, '-', CAST(page_id AS VARCHAR), '.xml') AS loc FROM pages WHERE page_id % 3 <> 2")
def a9(t):
    name = by("page_id", "'College'", "'course'", last="'news'")
    index = t.pages.select(F.concat(F.lit("https://x.example/"), name, F.lit("-"), F.col("page_id").cast("string"), F.lit(".xml")).alias("loc"))
    return index.where(P.of_families(F.col("loc"), ("college", "course")))


@query("A10_embedded_json", "SELECT course_id, name, college_count FROM courses WHERE course_id % 4 <> 3")
def a10(t):
    """Page props in either of two nestings; pages without them give nothing."""
    props = F.to_json(F.struct("course_id", "name", "college_count"))
    body = F.when(F.col("course_id") % 4 == 3, "var x = 1;").when(F.col("course_id") % 2 == 0, F.concat(F.lit('{"props": {"pageProps": {"data": '), props, F.lit("}}}"))).otherwise(F.concat(F.lit('{"props": {"initialProps": {"pageProps": {"data": '), props, F.lit("}}}}")))
    html = t.courses.select(F.concat(F.lit('<p>x</p><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script><p>y</p>")).alias("html"))
    v = F.try_parse_json(P.script_json(F.col("html")))
    data = F.coalesce(F.try_variant_get(v, "$.props.pageProps.data", "variant"), F.try_variant_get(v, "$.props.initialProps.pageProps.data", "variant"))
    return html.select(data.alias("v")).where("v is not null").select(V.field(F.col("v"), "$.course_id", "bigint").alias("course_id"), V.field(F.col("v"), "$.name", "string").alias("name"), V.field(F.col("v"), "$.college_count", "bigint").alias("college_count"))


@query("A11_state_objects", "SELECT course_id, CASE WHEN course_id % 5 = 4 THEN NULL ELSE concat('{\"id\": ', CAST(course_id AS VARCHAR), ', a: {''}'': \"{\", \"b\": ''it', chr(92), '''s }''}, \"name\": \"', name, '\"}') END AS state FROM courses")
def a11(t):
    """Braces inside both kinds of quotes don't count; an object that never ends is none."""
    state = F.concat(F.lit('{"id": '), F.col("course_id").cast("string"), F.lit(""", a: {'}': "{", "b": 'it\\'s }'}, "name": \""""), "name", F.lit('"}'))
    html = F.concat(F.lit("<script>window.S = "), F.when(F.col("course_id") % 5 == 4, F.concat(F.lit("{"), state)).otherwise(state), F.lit("; go();</script>"))
    return P.script_state(t.courses.select("course_id", html.alias("html")), "html", "window.S").select("course_id", "state")


@query("A12_structured_data", "SELECT college_id, name FROM colleges WHERE college_id % 5 <> 4")
def a12(t):
    """The first college among a page's JSON-LD: alone, in a list, in a graph, with several types; broken blocks are passed over."""
    one = F.to_json(F.struct(F.lit("CollegeOrUniversity").alias("@type"), "name"))
    other, two = F.lit('{"@type": "WebSite", "name": "no"}'), F.concat(F.lit('{"@type": ["Place", "CollegeOrUniversity"], "name": '), F.to_json(F.array("name")), F.lit("}"))
    two = F.regexp_replace(two, r'"name": \[(.*)\]', '"name": $1')
    block = F.when(F.col("college_id") % 5 == 0, one).when(F.col("college_id") % 5 == 1, F.concat(F.lit("["), other, F.lit(","), one, F.lit("]"))).when(F.col("college_id") % 5 == 2, F.concat(F.lit('{"@context": "x", "@graph": ['), other, F.lit(","), one, F.lit("]}"))).when(F.col("college_id") % 5 == 3, two).otherwise(other)
    html = F.concat(F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), block, F.lit("</script>"))
    found = t.colleges.select("college_id", P.ld_first(html, "CollegeOrUniversity").alias("v"))
    return found.where("v is not null").select("college_id", V.field(F.col("v"), "$.name", "string").alias("name"))


@query("A13_table_cells", "SELECT course_id, stream, CASE WHEN course_id % 3 = 2 THEN NULL ELSE CAST(college_count AS VARCHAR) END AS fee FROM courses")
def a13(t):
    """Cells by their column's heading, wherever it stands."""
    cell = lambda c: F.concat(F.lit("<td> <b>"), F.col(c).cast("string"), F.lit("</b></td>"))
    head = by("course_id", "'<th>Course Name</th><th>Total Fees</th>'", "'<th>1st Year Fee</th><th>Course</th>'", last="'<th>Course</th><th>Seats</th>'")
    cells = F.when(F.col("course_id") % 3 == 1, F.concat(cell("college_count"), cell("stream"))).otherwise(F.concat(cell("stream"), cell("college_count")))
    html = F.concat(F.lit("<div><table class=x><tr>"), head, F.lit("</tr>\n<tr>"), cells, F.lit("</tr></table></div>"))
    rows = t.courses.select("course_id", F.inline(P.named_cells(html, {"stream": ("course",), "fee": ("fee",)})))
    return rows.select("course_id", "stream", "fee")


@query("A15_raw_rescan", "SELECT id, props FROM logs WHERE props IS NOT NULL ORDER BY id LIMIT 1000")
def a15(t):
    return t.logs.where("props is not null").select("id", "props").orderBy("id").limit(1000)


@query("A17_verdict_lines", "SELECT college_id AS l_id, college_id + 1 AS r_id, CASE WHEN college_id % 5 = 0 THEN 'yes' ELSE 'no' END AS verdict FROM colleges WHERE college_id % 5 IN (0, 1)")
def a17(t):
    """JSON lines of a judge: blank and broken lines and other words than yes and no are passed over."""
    line = lambda word: F.concat(F.lit('{"l": '), F.col("college_id").cast("string"), F.lit(', "r": '), (F.col("college_id") + 1).cast("string"), F.lit(f', "verdict": "{word}"}}'))
    k = F.col("college_id") % 5
    lines = t.colleges.select(F.when(k == 0, line(" YES ")).when(k == 1, line("no")).when(k == 2, F.lit(" ")).when(k == 3, F.lit('{"l": 1, "verdict": ')).otherwise(line("maybe")).alias("line"))
    v = F.try_parse_json("line")
    read = lines.select(V.field(v, "$.l", "bigint").alias("l_id"), V.field(v, "$.r", "bigint").alias("r_id"), F.lower(F.trim(V.field(v, "$.verdict", "string"))).alias("verdict"))
    return read.where(F.col("verdict").isin("yes", "no"))


@query("B4_workbook", "SELECT 'stream' AS sheet, stream AS label, count(*) AS n FROM courses GROUP BY stream UNION ALL SELECT 'type and level', concat(course_type, ' ', level), count(*) FROM courses GROUP BY course_type, level UNION ALL SELECT 'city', city, count(*) FROM offerings JOIN colleges USING (college_id) GROUP BY city UNION ALL SELECT 'fees', stream, count(nullif(fees_amount, 0)) FROM offerings JOIN courses USING (course_id) GROUP BY stream")
def b4(t):
    """Four sheets of counts as one long table."""
    sheet = lambda name, df, label: df.groupBy(label.alias("label")).agg(n()).select(F.lit(name).alias("sheet"), "label", "n")
    typed = t.courses.groupBy("course_type", "level").agg(n()).select(F.lit("type and level").alias("sheet"), F.concat_ws(" ", "course_type", "level").alias("label"), "n")
    fees = t.offerings.where("fees_amount <> 0").join(t.courses, "course_id")
    return sheet("stream", t.courses, F.col("stream")).union(typed).union(sheet("city", t.offerings.join(t.colleges, "college_id"), F.col("city"))).union(sheet("fees", fees, F.col("stream")))


@query("B9_export_allowed", "SELECT table_name, n_rows, n_bytes, n_bytes <= 20000 AS allowed FROM (SELECT 'colleges' AS table_name, count(*) AS n_rows, CAST(sum(length(CAST(college_id AS VARCHAR)) + length(coalesce(name, '')) + length(coalesce(city, '')) + 3) AS BIGINT) AS n_bytes FROM colleges UNION ALL SELECT 'directory', count(*), CAST(sum(length(CAST(college_id AS VARCHAR)) + length(coalesce(name, '')) + length(coalesce(city, '')) + 3) AS BIGINT) FROM directory)")
def b9(t):
    """Exports over a size are refused before they are written."""
    one = lambda name: sinks.size_estimate(getattr(t, name).select("college_id", "name", "city")).select(F.lit(name).alias("table_name"), "n_rows", "n_bytes", (F.col("n_bytes") <= 20_000).alias("allowed"))
    return one("colleges").union(one("directory"))


# ---- records (C, I) ----


@query("C3_highlights", "SELECT course_id, CASE course_id % 4 WHEN 0 THEN concat('[\"Fees: ', CAST(college_count AS VARCHAR), '\",\"Alone\"]') WHEN 1 THEN '[\"no title\"]' ELSE '' END AS highlights FROM courses")
def c3(t):
    item = by("course_id", """concat('[{"title": "<b>Fees</b>", "value": "', college_count, '"}, {"title": "Alone", "value": ""}]')""", """'[{"value": "no title"}]'""", "'[]'", last="'{\"x\": 1}'")
    v = F.try_parse_json(F.concat(F.lit('{"listingId": 1, "highlightsInfo": {"highlights": '), item, F.lit("}}")))
    return t.courses.select("course_id", *W.project(v, "highlights titled highlightsInfo.highlights"))


@query("C4_located_node", "SELECT course_id, CASE WHEN course_id % 5 IN (0, 1, 2) THEN name END AS name FROM courses")
def c4(t):
    """A college node at any of three depths, among objects that lack one of its keys; deeper ones are not looked for."""
    node = F.to_json(F.struct(F.col("course_id").alias("listingId"), F.col("name").alias("listingName")))
    decoy, k = '{"listingId": 0, "other": {"listingName": "no"}}', F.col("course_id") % 5
    body = F.when(k == 0, node).when(k == 1, F.concat(F.lit(f'{{"a": {decoy}, "b": '), node, F.lit("}"))).when(k == 2, F.concat(F.lit('{"x": [1, {"y": '), node, F.lit("}]}"))).when(k == 3, F.lit(decoy)).otherwise(F.concat(F.lit('{"a": {"b": {"c": {"d": '), node, F.lit("}}}}")))
    found = V.located(t.courses.select("course_id", F.try_parse_json(body).alias("v")), ["listingId", "listingName"])
    return found.select("course_id", V.field(F.col("node"), "$.listingName", "string").alias("name"))


@query("C5_flattened_nodes", "SELECT source_job_id AS job, id FROM offerings")
def c5(t):
    """Offerings in lists in objects in lists, as a payload of a job nests them."""
    one = F.struct("id", "course_id")
    nested = t.offerings.groupBy("source_job_id", F.floor(F.col("id") / 10).alias("page")).agg(F.array_sort(F.collect_list(one)).alias("xs"))
    body = F.to_json(F.struct(F.array(F.struct(F.col("xs").alias("items"), F.lit("x").alias("label"))).alias("groups")))
    return V.flattened(nested.select(F.col("source_job_id").alias("job"), F.try_parse_json(body).alias("v")), "course_id").select("job", V.field(F.col("node"), "$.id", "bigint").alias("id"))


@query("C7_search_four", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS id, {name} AS name FROM {table} WHERE {name} ILIKE '%ed%' OR {name} ILIKE '%00%7%'" for kind, table, key, name in (("college", "colleges", "college_id", "name"), ("course", "courses", "course_id", "name"), ("directory", "directory", "college_id", "name"), ("programme", "part", "p_partkey", "p_type"))) + ") ORDER BY kind, id LIMIT 500")
def c7(t):
    one = lambda df, kind, key, name: df.where(F.col(name).ilike("%ed%") | F.col(name).ilike("%00%7%")).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"))
    every = one(t.colleges, "college", "college_id", "name").union(one(t.courses, "course", "course_id", "name")).union(one(t.directory, "directory", "college_id", "name")).union(one(t.read("part"), "programme", "p_partkey", "p_type"))
    return every.orderBy("kind", "id").limit(500)


@query("C13_typed_entities", "SELECT college_id, CASE WHEN college_id % 4 = 0 THEN 'school' WHEN college_id % 3 = 0 THEN 'university' WHEN college_id % 3 = 1 THEN 'college' END AS entity FROM directory")
def c13(t):
    """The address tells the type, where none is stored."""
    url = F.concat(F.lit("https://h.example/"), by("college_id", "'university/'", "'college/'", last="'place/'"), F.col("college_id").cast("string"))
    told = F.when(F.contains(url, F.lit("/university/")), "university").when(F.contains(url, F.lit("/college/")), "college")
    stored = F.when(F.col("college_id") % 4 == 0, "school").when(F.col("college_id") % 4 == 1, "")
    return t.directory.select("college_id", F.coalesce(X.nonempty(stored), told).alias("entity"))


@query("C14_address_kinds", """SELECT course_id, CASE course_id % 7 WHEN 0 THEN 'college' WHEN 1 THEN 'college_tab' WHEN 2 THEN 'college_tab' WHEN 3 THEN 'offering' WHEN 4 THEN 'university' WHEN 5 THEN 'university_sub' ELSE 'other' END AS kind,
 CASE course_id % 7 WHEN 6 THEN NULL ELSE 'a-b-2' END AS slug, CASE course_id % 7 WHEN 6 THEN NULL ELSE course_id END AS item_id, CASE course_id % 7 WHEN 1 THEN 'fees' WHEN 2 THEN 'other' END AS tab FROM courses""")
def c14(t):
    i = F.col("course_id").cast("string")
    k = F.col("course_id") % 7
    path = (
        F.when(k == 0, F.concat(F.lit("/College/a-b-2-"), i, F.lit("/?x=1"))).when(k == 1, F.concat(F.lit("/college/a-b-2-"), i, F.lit("/fees/2024"))).when(k == 2, F.concat(F.lit("/college/a-b-2-"), i, F.lit("/gallery")))
        .when(k == 3, F.concat(F.lit("/college/z-9/course-a-b-2-"), i)).when(k == 4, F.concat(F.lit("/university/a-b-2-"), i, F.lit("/"))).when(k == 5, F.concat(F.lit("/university/a-b-2-"), i, F.lit("/courses"))).otherwise(F.concat(F.lit("/news/a-"), i))
    )
    return t.courses.select("course_id", X.address_kind(F.concat(F.lit("https://www.h.example"), path)).alias("x")).select("course_id", "x.kind", "x.slug", F.col("x.id").alias("item_id"), "x.tab")


@query("C15_block_pages", "SELECT page_id, page_id % 6 IN (0, 1, 2, 3) AS blocked FROM pages")
def c15(t):
    k = F.col("page_id") % 6
    late = F.concat(F.repeat(F.lit("x"), F.lit(20_000)), F.lit("__cf_chl_"))
    html = F.when(k == 0, F.concat(F.lit("<title lang=en> Just a moment... </title>"), "html")).when(k == 1, F.concat(F.lit("<div id='CF-Browser-Verification'>"), "html")).when(k == 2, F.lit(" \n ")).when(k == 3, F.lit(None).cast("string")).when(k == 4, late).otherwise(F.col("html"))
    return t.pages.select("page_id", P.block_page(html).alias("blocked"))


# ---- scalar rules (H) ----


@query("H5_scholarships", "SELECT course_id, CASE WHEN course_id % 3 <> 2 THEN college_count * 1000 END AS inr, CASE WHEN course_id % 3 <> 1 THEN college_count * 10 END AS amount, CASE WHEN course_id % 3 <> 1 THEN 'USD' END AS currency FROM courses")
def h5(t):
    c = F.col("college_count").cast("string")
    rupees, dollars = F.concat(F.lit("₹ "), c, F.lit(",000")), F.concat(F.lit("($"), c, F.lit("0)"))
    text = F.when(F.col("course_id") % 3 == 0, F.concat_ws(" ", rupees, dollars)).when(F.col("course_id") % 3 == 1, rupees).otherwise(F.concat(F.lit("up to "), dollars))
    inr, amount, currency = W.scholarship_amount(text)
    return t.courses.select("course_id", inr.alias("inr"), amount.alias("amount"), currency.alias("currency"))


@query("H6_clean_fees", "SELECT course_id, CASE course_id % 4 WHEN 0 THEN concat('₹', CAST(college_count AS VARCHAR), ' (1st Year)') WHEN 1 THEN concat('₹', CAST(college_count AS VARCHAR), '.5 Lakhs') WHEN 2 THEN '' ELSE 'on request' END AS fee FROM courses")
def h6(t):
    text = by("course_id", "concat(' ', college_count, '(1st Year) ')", "concat('₹  ', college_count, '.5  Lakhs')", "' -- '", last="'on request'")
    return t.courses.select("course_id", X.clean_fee(text).alias("fee"))


@query("H7_clean_dates", "SELECT course_id, CASE course_id % 3 WHEN 2 THEN '2024-05-01' ELSE '' END AS day FROM courses")
def h7(t):
    return t.courses.select("course_id", X.clean_date(by("course_id", "'0000-00-00'", "NULL", last="' 2024-05-01 '")).alias("day"))


@query("H14_short_forms", "SELECT college_id, CASE WHEN college_id >= 1 THEN concat('it', CAST(college_id AS VARCHAR)) ELSE 'it0' END AS k FROM colleges")
def h14(t):
    return t.colleges.select("college_id", X.shortform_key(F.concat(F.lit("I.T. - "), F.col("college_id").cast("string"))).alias("k"))


@query("H16_plain_words", f"SELECT college_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(concat('The A B of ', name, ' ', city)), '[^a-z0-9]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({', '.join(repr(w) for w in X.STOP_WORDS)})))), ' ') AS words FROM directory")
def h16(t):
    return t.directory.select("college_id", F.array_join(F.array_sort(X.plain_tokens(F.concat(F.lit("The A B of "), "name", F.lit(" "), "city"))), " ").alias("words"))


@query("H18_stream_names", f"SELECT course_id, CASE WHEN k = 22 THEN '' ELSE coalesce((CASE WHEN k > 0 THEN [{', '.join(f"'{x}'" for x in X.STREAMS)}] END)[k], concat('Stream ', CAST(k AS VARCHAR))) END AS stream_label FROM (SELECT course_id, course_id % 25 AS k FROM courses)")
def h18(t):
    text = F.when(F.col("course_id") % 25 == 22, "none").otherwise((F.col("course_id") % 25).cast("string"))
    return t.courses.select("course_id", X.stream_name(text).alias("stream_label"))


@query("H19_names_joined", "SELECT course_id, CASE course_id % 4 WHEN 0 THEN concat(stream, ', ', name) WHEN 1 THEN name WHEN 2 THEN stream ELSE '' END AS joined FROM courses")
def h19(t):
    s, m = F.to_json(F.array("stream")), F.to_json(F.array("name"))
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    body = F.when(F.col("course_id") % 4 == 0, F.concat(F.lit("["), inner(s), F.lit(', {"name": '), inner(m), F.lit('}, "", '), inner(s), F.lit("]"))).when(F.col("course_id") % 4 == 1, F.concat(F.lit('[{"name": '), inner(m), F.lit("}, null]"))).when(F.col("course_id") % 4 == 2, inner(s)).otherwise("7")
    return t.courses.select("course_id", V.names_joined(F.try_parse_json(body)).alias("joined"))


@query("H28_encoded_payloads", "SELECT course_id, base64(encode(concat('{\"page\":', CAST(course_id AS VARCHAR), ',\"level\":\"', level, '\"}'))) AS payload FROM courses")
def h28(t):
    return t.courses.select("course_id", X.encoded(F.struct(F.col("course_id").alias("page"), "level")).alias("payload"))


@query("O9_airports_repaired", "SELECT college_id, CASE college_id % 4 WHEN 3 THEN NULL ELSE city END AS airport, CASE WHEN college_id % 4 < 2 THEN college_id * 10 END AS distance FROM colleges")
def o9(t):
    """An object stored as JSON or as a Python literal, or a plain name."""
    k = F.col("college_id") % 4
    d = (F.col("college_id") * 10).cast("string")
    stored = F.when(k == 0, F.concat(F.lit('{"name": "'), "city", F.lit('", "distance": '), d, F.lit("}"))).when(k == 1, F.concat(F.lit("{'name': '"), "city", F.lit("', 'distance': "), d, F.lit(", 'code': None, 'open': True}"))).when(k == 2, F.col("city")).otherwise("{'name': ")
    v = V.repaired(stored)
    bare = F.when(~stored.rlike(r"^\s*[\[{]"), F.trim(stored))
    out = t.colleges.select("college_id", v.alias("v"), bare.alias("bare"))
    return out.select("college_id", F.coalesce(V.first_text(F.col("v"), "$.name"), "bare").alias("airport"), V.field(F.col("v"), "$.distance", "bigint").alias("distance"))


# ---- writes and governance (J, K, P) ----


@query("J10_scoped_wipe", "SELECT 'courses' AS table_name, count(*) AS n FROM courses UNION ALL SELECT 'colleges', count(*) FROM colleges UNION ALL SELECT 'offerings', 0 UNION ALL SELECT 'progress', 0")
def j10(t):
    """A reset that keeps courses and colleges: the other tables keep their columns and no row."""
    keep = ("courses", "colleges")
    wiped = {x: getattr(t, x) if x in keep else getattr(t, x).where("false") for x in ("courses", "colleges", "offerings", "progress")}
    one = lambda x: wiped[x].agg(n()).select(F.lit(x).alias("table_name"), "n")
    return one("courses").union(one("colleges")).union(one("offerings")).union(one("progress"))


@query("J12_coalesce_patch", "SELECT c.college_id, coalesce(CASE WHEN d.college_id % 2 = 0 THEN d.city END, c.city) AS city, c.name FROM colleges c LEFT JOIN directory d ON d.college_id = c.college_id")
def j12(t):
    batch = t.directory.select("college_id", F.when(F.col("college_id") % 2 == 0, F.col("city")).alias("city"))
    return merge.patched(t.colleges.select("college_id", "city", "name"), batch, ["college_id"])


@query("J13_added_columns", "SELECT college_id, name, NULL AS ownership FROM colleges UNION ALL SELECT college_id, name, ownership FROM directory WHERE college_id NOT IN (SELECT college_id FROM colleges)")
def j13(t):
    """Rows with a column that the table lacked: it is added, and is absent in the old rows."""
    new = t.directory.select("college_id", "name", "ownership").join(t.colleges, "college_id", "left_anti")
    return t.colleges.select("college_id", "name").unionByName(new, allowMissingColumns=True)


PAYLOADS = "SELECT user_id AS job_id, event_type AS table_name, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 40 AS BIGINT) END AS k1, CAST(user_id % 7 AS BIGINT) AS k2, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN concat(chr(123), props) ELSE props END AS payload FROM {events}"


def payloads(t):
    return t.spark.sql(PAYLOADS, events=t.read("events"))


def staged_sql(rule: str, key: str) -> str:
    return f"SELECT job_id, table_name, pk, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id, table_name, pk ORDER BY seq DESC) AS r FROM (SELECT *, {key} AS pk FROM ({PAYLOADS.format(events='events')}) {rule})) WHERE r = 1"


@query("K1_staged_whole_keys", staged_sql("WHERE k1 IS NOT NULL", "concat(CAST(k1 AS VARCHAR), '|', CAST(k2 AS VARCHAR))"))
def k1(t):
    return merge.staged(payloads(t), ["k1", "k2"], ["seq"]).select("job_id", "table_name", "pk", "seq")


@query("K1_staged_literal_nulls", staged_sql("", "concat(coalesce(CAST(k1 AS VARCHAR), 'None'), '|', CAST(k2 AS VARCHAR))"))
def k1_literal(t):
    return merge.staged(payloads(t), ["k1", "k2"], ["seq"], literal_nulls=True).select("job_id", "table_name", "pk", "seq")


@query("K4_flat_scores", "SELECT job, rows_n, score, rows_n >= 100 AND score >= 70 AS passed FROM (SELECT source_job_id AS job, count(*) AS rows_n, 100 - CASE WHEN count(*) < 100 THEN 50 ELSE 0 END - CASE WHEN 100.0 * count(*) FILTER (WHERE rating = 0) / count(*) > 33.0 THEN 30 ELSE 0 END AS score FROM offerings GROUP BY source_job_id)")
def k4(t):
    g = t.offerings.groupBy(F.col("source_job_id").alias("job")).agg(n("rows_n"), F.count_if(F.col("rating") == 0).alias("m"))
    score = R.flat_score(F.col("rows_n"), 100.0 * F.col("m") / F.col("rows_n"), 100, 33.0)
    return g.select("job", "rows_n", score.alias("score"), ((F.col("rows_n") >= 100) & (score >= 70)).alias("passed"))


@query("K5_promoted_rows", f"WITH s AS (SELECT *, CAST(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.k') AS BIGINT) AS v FROM ({PAYLOADS.format(events='events')}) WHERE k1 IS NOT NULL AND json_valid(payload)), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY seq DESC) AS r FROM s) WHERE r = 1) SELECT coalesce(c.college_id, l.k1) AS college_id, c.name, l.v AS value, l.job_id AS source_job_id FROM colleges c FULL OUTER JOIN l ON l.k1 = c.college_id")
def k5(t):
    """Staged rows in their order over the master: broken payloads go, the last row of a key stays, the job is stamped."""
    rows = payloads(t).withColumn("v", F.try_parse_json("payload")).where("v is not null and k1 is not null")
    batch = merge.last_wins(rows.select(F.col("k1").alias("college_id"), V.field(F.col("v"), "$.k", "bigint").alias("value"), F.col("job_id").alias("source_job_id"), "seq"), ["college_id"], ["seq"]).drop("seq")
    none = F.lit(None).cast("long")
    return merge.upsert(t.colleges.select("college_id", "name", none.alias("value"), none.alias("source_job_id")), batch, ["college_id"], merge.preserve)


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
LANG = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)"


@query("P3_grown_states", f"SELECT host, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, max(page_id) AS newest, (list(url ORDER BY length(url), url))[1] AS url FROM (SELECT page_id, url, {HOST} AS host, {LANG} AS lang FROM pages) GROUP BY host")
def p3(t):
    """The state of each host from two batches, as a harvest grows it file by file."""
    p = t.pages.select("page_id", "url", F.expr(HOST.replace("regexp_extract(url, '", "regexp_extract(url, r'")).alias("host"), F.expr(LANG.replace("regexp_extract(url, '", "regexp_extract(url, r'")).alias("lang"))
    state = lambda df: df.groupBy("host").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.max("page_id").alias("newest"), F.min_by("url", F.struct(F.length("url"), "url")).alias("url"))
    out = R.grown(state(p.where("page_id % 2 = 0")), state(p.where("page_id % 2 = 1")), "host", ["langs"], ["newest"], ["url"])
    return out.select("host", F.array_join("langs", ",").alias("langs"), "newest", "url")


# ---- rules inside phases (T) ----


@query("T1_facets_exploded", "SELECT 'level' AS filter, level AS value, lower(level) AS label, CASE WHEN level = '' THEN 0 ELSE count(*) END AS n FROM courses GROUP BY level UNION ALL SELECT 'stream', stream, lower(stream), count(*) FROM courses GROUP BY stream")
def t1(t):
    """A filters object, key by key and value by value; a count that isn't there is 0."""
    one = lambda c: t.courses.groupBy(c).agg(n()).select(F.lit(c).alias("f"), F.struct(F.col(c).alias("value"), F.lower(c).alias("label"), F.when(F.col(c) != "", F.col("n")).alias("count")).alias("x"))
    filters = one("level").union(one("stream")).groupBy("f").agg(F.collect_list("x").alias("xs")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("f", "xs")))).alias("json"))
    read = filters.select(F.explode(F.from_json("json", "map<string,array<struct<value:string,label:string,count:bigint>>>")).alias("filter", "xs"))
    return read.select("filter", F.inline("xs")).select("filter", "value", "label", F.coalesce("count", F.lit(0)).alias("n"))


@query("T2_country_rows", "SELECT DISTINCT lower(n_name) AS code, CASE WHEN n_nationkey % 2 = 0 THEN concat('Nation ', CAST(n_nationkey AS VARCHAR)) ELSE upper(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def t2(t):
    """Countries met on programme rows get their code as a name, until a better one is known."""
    rows = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    met = rows.select(F.lower("n_name").alias("code"), F.upper("n_name").alias("name")).distinct()
    known = t.read("nation").select(F.lower("n_name").alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string"))).alias("name"))
    return merge.update_only(met, known, ["code"])


PAGED = "(SELECT o.id // 50 AS page, o.id % 50 AS pos, c.name, c.course_type, c.stream, concat(c.name, ' ', c.stream) AS full_name FROM offerings o JOIN courses c USING (course_id))"


@query("T3_dedupe_across_pages", f"SELECT name, course_type, full_name, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), lower(course_type), lower(full_name) ORDER BY page, pos) AS r, first_value(page * 50 + pos) OVER (PARTITION BY lower(name), lower(course_type) ORDER BY page, pos) AS g FROM {PAGED}) WHERE r = 1 AND page * 50 + pos <= g + 5000")
def t3(t):
    """Groups by name and type, rows by full name inside them; the first across pages stays. Rows long after their group began are new groups."""
    o = t.offerings.join(t.courses, "course_id").select(F.floor(F.col("id") / 50).alias("page"), (F.col("id") % 50).alias("pos"), "name", "course_type", F.concat_ws(" ", "name", "stream").alias("full_name"))
    group = [F.lower("name"), F.lower("course_type")]
    began = F.first(F.col("page") * 50 + F.col("pos")).over(Window.partitionBy(*group).orderBy("page", "pos"))
    first = R.top_k(o.withColumn("g", began), [*group, F.lower("full_name")], [F.col("page"), F.col("pos")], 1)
    return first.where("page * 50 + pos <= g + 5000").select("name", "course_type", "full_name", "page", "pos")


@query("T4_address_fallback", "SELECT d.college_id, coalesce(nullif(c.website, ''), nullif(d.website, ''), concat('/c/', CAST(d.college_id AS VARCHAR))) AS url, coalesce(nullif(c.name, ''), nullif(d.name, '')) AS name FROM directory d LEFT JOIN colleges c ON c.college_id = d.college_id")
def t4(t):
    """A row's own address, else the page's; a name through the chain of tables."""
    c = t.colleges.select("college_id", F.col("website").alias("cw"), F.col("name").alias("cn"))
    j = t.directory.join(c, "college_id", "left")
    own = F.concat(F.lit("/c/"), F.col("college_id").cast("string"))
    return j.select("college_id", F.coalesce(X.nonempty(F.col("cw")), X.nonempty(F.col("website")), own).alias("url"), F.coalesce(X.nonempty(F.col("cn")), X.nonempty(F.col("name"))).alias("name"))


AUDIT = "CASE WHEN f = 0 THEN 'empty' WHEN page_college <> asked THEN 'redirected' WHEN f >= 30 THEN 'error' WHEN f < expected THEN 'short' ELSE 'whole' END"


@query("T6_page_audit", f"SELECT asked, expected, f AS found, {AUDIT} AS verdict FROM (SELECT c.course_id AS asked, c.college_count AS expected, coalesce(o.f, 0) AS f, CASE WHEN c.course_id % 9 = 0 THEN c.course_id + 1 ELSE c.course_id END AS page_college FROM courses c LEFT JOIN (SELECT course_id, count(*) AS f FROM offerings GROUP BY course_id) o ON o.course_id = c.course_id)")
def t6(t):
    """What a page advertised against what was found: another id is a redirect, a full last page is cut off."""
    found = t.offerings.groupBy("course_id").agg(n("f"))
    page = F.when(F.col("course_id") % 9 == 0, F.col("course_id") + 1).otherwise(F.col("course_id"))
    j = t.courses.join(found, "course_id", "left").select(F.col("course_id").alias("asked"), F.col("college_count").alias("expected"), F.coalesce("f", F.lit(0)).alias("found"), page.alias("_page"))
    verdict = F.when(F.col("found") == 0, "empty").when(F.col("_page") != F.col("asked"), "redirected").when(F.col("found") >= 30, "error").when(F.col("found") < F.col("expected"), "short").otherwise("whole")
    return j.select("asked", "expected", "found", verdict.alias("verdict"))


@query("T7_identity_precedence", "SELECT phase, college_id, count(*) AS n FROM (SELECT 'listing' AS phase, college_id FROM offerings UNION ALL SELECT 'deep', first_value(college_id) OVER (PARTITION BY id // 10 ORDER BY id, college_id) FROM offerings) GROUP BY phase, college_id")
def t7(t):
    """A listing trusts the id on the page, a deep pass the id in the queue (here: of the page's first line)."""
    queue = F.first("college_id").over(Window.partitionBy(F.floor(F.col("id") / 10)).orderBy("id", "college_id"))
    rows = t.offerings.select("college_id", queue.alias("asked"))
    return rows.select(F.explode(F.array(F.struct(F.lit("listing").alias("phase"), F.col("college_id").alias("college_id")), F.struct(F.lit("deep").alias("phase"), F.col("asked").alias("college_id")))).alias("x")).groupBy("x.phase", "x.college_id").agg(n())


@query("T8_gone_pages", "SELECT p.college_id, CASE WHEN p.college_id % 5 = 0 THEN 'gone' ELSE p.status END AS status, p.found, CASE WHEN p.college_id % 10 <> 5 THEN TIMESTAMP '2024-06-01 00:00:00' END AS deep_at FROM progress p")
def t8(t):
    """A gone page ends the detail queue; a deep pass stamps an otherwise empty row, and a failed one nothing."""
    gone = t.progress.where("college_id % 5 = 0").select("college_id", F.lit("gone").alias("status"))
    stamp = t.progress.where("college_id % 10 <> 5").select("college_id", F.lit(None).cast("string").alias("status"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("deep_at"))
    base = t.progress.select("college_id", "status", "found", F.lit(None).cast("timestamp").alias("deep_at"))
    return merge.upsert(merge.upsert(base, gone, ["college_id"], merge.preserve), stamp, ["college_id"], merge.preserve)


@query("T9_enriched_or_blocked", "SELECT college_id, CASE college_id % 3 WHEN 0 THEN phone ELSE CASE WHEN college_id % 3 = 1 THEN phone ELSE '+1' END END AS phone, college_id % 3 <> 0 AS enriched FROM colleges")
def t9(t):
    """A valid page without contacts still marks its college as enriched; a blocked page doesn't."""
    k = F.col("college_id") % 3
    html = F.when(k == 0, "<title>Access denied</title>").when(k == 1, "<title>A college</title>").otherwise('<title>A college</title><a href="tel:+1">call</a>')
    fetched = t.colleges.select("college_id", html.alias("html")).where(~P.block_page(F.col("html")))
    batch = fetched.select("college_id", F.regexp_extract("html", 'href="tel:([^"]*)"', 1).alias("phone"), F.lit(True).alias("enriched"))
    return merge.update_only(t.colleges.select("college_id", "phone", F.lit(False).alias("enriched")), batch, ["college_id"])


@query("O8_reextracted", "SELECT college_id, coalesce(nullif(website, ''), concat('https://re.example/', CAST(college_id AS VARCHAR))) AS website, coalesce(website, '') = '' AS filled FROM colleges")
def o8(t):
    """Stored payloads are parsed again without a fetch; only blanks are filled."""
    raw = t.colleges.select("college_id", F.to_json(F.struct(F.concat(F.lit("https://re.example/"), F.col("college_id").cast("string")).alias("site"))).alias("raw"))
    parsed = raw.select("college_id", V.first_text(F.try_parse_json("raw"), "$.website", "$.site").alias("website"))
    old = t.colleges.select("college_id", "website")
    out = merge.update_only(old, parsed, ["college_id"], merge.fill_empty)
    return out.join(old.select("college_id", X.missing(F.col("website")).alias("filled")), "college_id").select("college_id", "website", "filled")
