"""Wide rows from harvested JSON records: each field is a column name, a kind and the paths that may hold it.

Kinds: ``text`` (markup and entities gone; ``:n`` keeps n characters), ``raw`` (text as it is), ``int``,
``real`` (``:n`` rounds), ``flag`` (1 or 0), ``flag?`` (1, 0 or NULL where absent), ``list`` (a JSON list of texts; ``:key,key``
names the members that may hold an item's text), ``json`` (the node itself, '' if it is empty), ``steps``
(a map keyed '1', '2', '10' as a JSON list in that order). An absent text, list or node is '', an absent
number NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .payload import field, kind_of, ordered_steps
from .text import absolute_url, duration_months, unescaped

# Most items of a list, characters of one, and characters of a JSON cell.
LIST_ITEMS, ITEM_CHARS, JSON_CHARS = 60, 200, 4000

# Members of a college page's node.
COLLEGE = """
college_id          int       instituteId listingId sdListingId
name                text:300  instituteTopCardData.instituteName listingName shortName
short_name          text:200  instituteTopCardData.instituteShortName shortName
college_type        text:60   instituteTopCardData.instituteSpecificationType
ownership           text:40   ownership
tier                text:40   instituteTier
city                text:120  currentLocation.city_name
state               text:120  currentLocation.state_name
city_id             int       currentLocation.city_id
state_id            int       currentLocation.state_id
locality            text:120  currentLocation.locality_name
country_id          int       countryId
address             text:600  currentLocation.contact_details.address currentLocation.contact_details.full_address
website             text:300  currentLocation.contact_details.website_url currentLocation.contact_details.website
phone               text:120  currentLocation.contact_details.admission_contact_number currentLocation.contact_details.generic_contact_number
email               text:200  currentLocation.contact_details.admission_email currentLocation.contact_details.generic_email
latitude            real      currentLocation.contact_details.latitude
longitude           real      currentLocation.contact_details.longitude
logo                text:400  instituteTopCardData.logoImageUrl
rating              real:2    instituteTopCardData.reviewDetails.averageRating instituteTopCardData.reviewDetails.rating
reviews_count       int       instituteTopCardData.reviewDetails.totalCount instituteTopCardData.reviewDetails.count
reviews_verified    int       instituteTopCardData.reviewDetails.verifiedCount
questions_count     int       anaCountString
photo_count         int       instituteTopCardData.photoCount
video_count         int       instituteTopCardData.videoCount
base_course_count   int       totalBaseCourseCount
flagship_course_id  int       flagshipCourseId
parent_university   text:300  instituteTopCardData.parentUniversityData.name instituteTopCardData.parentUniversityData.displayName
affiliations        list:name,universityName,displayName  instituteTopCardData.affiliationData
facilities          list:facilityName  facilityInfo
recruiters          list:companyName  recruitmentCompanies
streams             list:name  streamObjects
accepted_exams      list:name,examName,fullName  acceptedExams admissionData.examList
rankings            list:rankingString,name  instituteTopCardData.rankingData
highlights          titled    highlightsInfo.highlights
admission_text      text:4000 admissionData.admissionDetails
admission_updated   text:40   admissionData.admissionPostedDate
description         text:4000 description
meta_title          text:200  seoData.metaTitle
meta_description    text:400  seoData.metaDescription
canonical_url       text:400  seoData.canonicalUrl seoUrl
tab_urls            keys      childPageToUrls
"""

# Members of a course tuple on a listing page.
LISTING = """
course_id           int       courseId
url                 text:400  url
course_name         text:300  name
fees_amount         int       fees
level               text:40   courseLevel.name courseLevel
exams               list:name,examName  exams
base_course_id      int       baseCourseId
base_course_name    text:200  baseCourseName
total_seats         int       totalSeats
median_salary       int       courseMedianSalary
rating              real      courseRating
rating_count        int       ratingCount
money_rating        real      moneyRating
scholarships_count  int       scholarshipsCount
eligibility_x       int       eligibilityX
eligibility_xii     int       eligibilityXII
eligibility_grad    int       eligibilityGraduation
eligibility_pg      int       eligibilityPostGraduation
work_experience     text:200  workExpString
difficulty_level    text:60   difficultyLevel
skills              list:name skills
credential          text:60   credential.name credential
is_online           flag      isOnline
curriculum_pdf      text:400  curricullumPDF
intake_dates        list      intakeDates
commencement_dates  list      courseCommencementDates
admission_status    text:60   courseAdmissionStatus
exams_count         int       totalExamsCount
institute_grade     text:40   instituteGrade
ranking             text:200  rankingString
"""

# Members of a course page's node.
DETAIL = """
college_id          int       instituteId
course_id           int       courseId
course_name         text:300  courseName
base_course_name    text:200  baseCourseName
specialization      text:200  specializationName
specialization_id   int       entryCourseTypeInformation.hierarchy[0].specialization_id
substream           text:200  substreamName
substream_id        int       entryCourseTypeInformation.hierarchy[0].substream_id
stream_id           int       entryCourseTypeInformation.hierarchy[0].stream_id
course_level        text:40   entryCourseTypeInformation.course_level.name
credential          text:60   entryCourseTypeInformation.credential.name
education_type      text:60   educationType.name
delivery_method     text:60   deliveryMethod.name
medium              list:name mediumOfInstruction
course_type         text:60   courseType
institute_type      text:60   instituteType
course_variant      int       courseVariant
is_course_paid      flag      isCoursePaid
nzqf                text:120  nzqfCategorization.name
fees_total          int       courseFees.fees.totalFees.general.value
fees_onetime        int       courseFees.fees.oneTimePayment.general.value
fees_hostel         int       courseFees.fees.hostelFees.general.value
fees_deposit        int       courseFees.fees.deposit.general.value
fees_other          int       courseFees.fees.otherFees
fees_total_json     json      courseFees.fees.totalFees
fees_onetime_json   json      courseFees.fees.oneTimePayment
fees_hostel_json    json      courseFees.fees.hostelFees
fees_deposit_json   json      courseFees.fees.deposit
fees_period_json    json      courseFees.fees.fees
fees_period_type    text:40   courseFees.fees.periodType
fees_includes       list      courseFees.fees.totalIncludes
fees_categories     json      courseFees.categoryNameMapping
fees_location_json  json      courseFees.locationWiseFees
fees_year           int       courseFees.year
fees_currency       text:8    courseFees.feesUnitName
fees_note           text:600  courseFees.description
fees_hostel_note    text:600  courseFees.hostelDescription
fees_onetime_note   text:600  courseFees.otpDescription
fees_deposit_note   text:600  courseFees.depositDescription
fees_brochure_url   text:400  courseFees.feesBrochureUrl
elig_year           int       eligibility.year
elig_x_json         json      eligibility.tenthDetails
elig_xii_json       json      eligibility.twelthDetails
elig_grad_json      json      eligibility.graduationDetails
elig_pg_json        json      eligibility.postGraduationDetails
elig_xii_general    int       eligibility.twelthDetails.categoryWiseScores.general.score
elig_xii_scores     json      eligibility.twelthDetails.categoryWiseScores
elig_xii_score_type text:40   eligibility.twelthDetails.scoreType
elig_exams_json     json      eligibility.exams
elig_min_workex     int       eligibility.minWorkEx
elig_max_workex     int       eligibility.maxWorkEx
elig_min_age        int       eligibility.minAge
elig_max_age        int       eligibility.maxAge
elig_backlogs       int       eligibility.numberofBacklog
elig_note           text:2000 eligibility.description
elig_intl_note      text:1000 eligibility.internationalDescription
curriculum_pdf      text:400  courseStructure.curriculumPdfUrl
course_period       text:60   courseStructure.period
period_courses_json json      courseStructure.periodWiseCourses
admission_steps     steps     admissionProcess
seats_total         int       seatsData.totalSeats
seats_category_json json      seatsData.categoryWiseSeats
seats_exam_json     json      seatsData.examWiseSeats
seats_domicile_json json      seatsData.domicileWiseSeats
placement_grain     text:40   placements.course_type
placement_batch_year int      placements.batch_year
placement_pct       real      placements.percentage_batch_placed
salary_avg          int       placements.avg_salary
salary_median       int       placements.median_salary
salary_max          int       placements.max_salary
salary_min          int       placements.min_salary
salary_currency     text:8    placements.salary_unit_name
placement_report_url text:400 placements.report_url
internships_available flag?   placements.is_internship_available
recruiters          list:companyName  recruitmentCompanies
affiliation_university_id int affiliationData.universityId
affiliation_name    text:200  affiliationData.name
affiliation_url     text:400  affiliationData.url
affiliation_scope   text:40   affiliationData.scope
highlights          list:description  highlights
important_dates_json json     importantDates.entityWiseDates
"""

# Members of a programme record abroad.
PROGRAMME = """
program_id          int       course_id
name                raw       head_one
name_secondary      raw       head_two
course_tags         raw       course_tags
program_type        raw       program_type
duration_text       raw       course_duration
languages           raw       course_languages
is_stem             flag      is_stem
is_partner          flag      is_partner
fee_native_raw      raw       default_fee_per_year
fee_inr_raw         raw       total_fee_per_year
application_end_date raw      application_end_date
university_id       int       lead_params.college_id
university_name     raw       college_name
university_url      raw       college_url
program_url         raw       course_link
logo_url            raw       college_logo
ranking_rank        int       ranking.rank
ranking_out_of      int       ranking.rank_out_of
ranking_scope       raw       ranking.scope
ranking_agency      raw       ranking.agencyName ranking.agencyShortForm
ranking_year        int       ranking.year
description         raw:4000  course_description
"""

# Members of a university page abroad.
UNIVERSITY = """
name                raw       basic_info.head.college
short_name          raw       basic_info.head.college_short
city                raw       basic_info.head.city
city_id             int       basic_info.head.city_id
state               raw       basic_info.head.state
state_id            int       basic_info.head.state_id
country_id          int       basic_info.head.country_id
country_name        raw       basic_info.head.country country_name
established_year    int       basic_info.head.establish_year
institution_type    raw       basic_info.head.institution_type
school_type         raw       basic_info.head.school_type
admin_rating        real      basic_info.head.admin_rating
cover_image         raw       basic_info.head.cover_image
website             raw       contact_location.website
address             raw       contact_location.address
email               raw       contact_location.college_mail_id
phone               raw       contact_location.contact
toll_free           raw       contact_location.toll_free_number
latitude            raw       contact_location.latitude
longitude           raw       contact_location.longitude
total_students      int       basic_info.head.total_students
total_faculty       int       faculty_stats.total_faculty
faculty_full_time   int       faculty_stats.full_time
faculty_part_time   int       faculty_stats.part_time
graduate_assistants int       faculty_stats.graduate_assistants
avg_rating          real      college_rating.average_rating review_stats.average_rating
total_reviews       int       college_rating.total_reviews review_stats.total_reviews
attendance_cost     raw       tuition_fees.attendance_cost
description         raw       article.description
"""


def plain_text(c: Column) -> Column:
    """Without tags and runs of white space, character references resolved."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, "<[^>]+>", " ")), r"[\s\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def number(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def whole(c: Column) -> Column:
    return number(c).try_cast("long")


def items(found: Column, keys: list[str]) -> Column:
    """The texts of a list's items; an item is a text or an object with one of the keys. Each item is opened once."""
    kind = struct_of(dict.fromkeys(keys or ["_"], "string"))
    opened = F.transform(found, lambda x: F.struct(field(x, "$", kind).alias("o"), x.alias("x")))
    text = lambda e: F.coalesce(*(F.nullif(e["o"][k], F.lit("")) for k in keys), F.when(e["o"].isNull(), field(e["x"], "$", "string")))
    return F.filter(F.transform(opened, text), lambda x: x.isNotNull() & (x != ""))


def as_list(texts: Column) -> Column:
    kept = F.slice(F.transform(texts, lambda x: F.left(x, F.lit(ITEM_CHARS))), 1, LIST_ITEMS)
    return F.coalesce(F.nullif(F.to_json(kept), F.lit("[]")), F.lit(""))


def as_json(node: Column) -> Column:
    text = F.to_json(node)
    return F.when(text.isNull() | text.isin("{}", "[]", "null"), "").otherwise(F.left(text, F.lit(JSON_CHARS)))


# What reads the value at a path as a type; NULL where the path is missing or holds another type.
Reader = Callable[[str, str], Column]

# Types in which kinds are read; others are read as texts.
READ_AS = {"list": "array<variant>", "titled": "array<variant>", "keys": "map<string,variant>", "steps": "map<string,variant>", "json": "variant"}


def fields_of(fields: str) -> list[tuple[str, str, list[str]]]:
    """(column, kind, paths) of each line of a field table."""
    return [(name, kind, paths) for name, kind, *paths in map(str.split, fields.strip().splitlines())]


def struct_of(types: dict[str, str]) -> str:
    return f"struct<{','.join(f'`{k}`:{kind}' for k, kind in types.items())}>"


def members(fields: str, texts: Sequence[str] = ()) -> dict[str, str]:
    """The members of an object that a field table and ``texts`` name, and the type in which each is read."""
    types: dict[str, str] = dict.fromkeys(texts, "string")
    for _, kind, paths in fields_of(fields):
        for path in paths:
            head = re.split(r"[.\[]", path)[0]
            wanted = READ_AS.get(kind.partition(":")[0], "string") if head == path else "variant"
            types[head] = wanted if types.get(head, wanted) == wanted else "variant"
    return types


def reader(node: Column, types: dict[str, str]) -> Reader:
    """Reads from an object that was opened as a struct of ``types``, so that no path is looked for again."""

    def read(path: str, kind: str) -> Column:
        head = re.split(r"[.\[]", path)[0]
        return node[head] if types[head] == kind and head == path else field(node[head], "$" + path[len(head) :], kind)

    return read


def column_of(read: Reader, kind: str, paths: list[str]) -> Column:
    kind, _, option = kind.partition(":")
    texts = [F.nullif(F.trim(read(p, "string")), F.lit("")) for p in paths]
    clip = lambda c: F.left(c, F.lit(int(option))) if option else c
    match kind:
        case "text":
            *others, last = map(plain_text, texts)
            return clip(F.coalesce(*(F.nullif(t, F.lit("")) for t in others), last, F.lit("")))
        case "raw":
            return clip(F.coalesce(*texts, F.lit("")))
        case "int":
            return F.coalesce(*(whole(t) for t in texts))
        case "real":
            value = F.coalesce(*(number(t) for t in texts))
            return F.round(value, int(option)) if option else value
        case "flag" | "flag?":
            known = F.when(texts[0].isin("false", "0", "[]", "{}"), 0).when(texts[0].isNotNull(), 1)
            return known if kind == "flag?" else F.coalesce(known, F.lit(0))
        case "list":
            found = [F.coalesce(items(read(p, "array<variant>"), option.split(",") if option else []), F.array().cast("array<string>")) for p in paths]
            return as_list(F.array_distinct(F.concat(*found)) if len(found) > 1 else found[0])
        case "titled":
            part = lambda x, *keys: F.coalesce(*(F.nullif(plain_text(field(x, f"$.{k}", "string")), F.lit("")) for k in keys), F.lit(""))
            line = lambda x: F.trim(F.concat(F.left(part(x, "title", "key", "name"), F.lit(80)), F.lit(": "), F.left(part(x, "value", "description"), F.lit(160))), F.lit(": "))
            found = F.filter(F.transform(read(paths[0], "array<variant>"), line), lambda x: x != "")
            return as_list(F.coalesce(found, F.array().cast("array<string>")))
        case "keys":
            return as_list(F.array_sort(F.map_keys(read(paths[0], "map<string,variant>"))))
        case "steps":
            return F.coalesce(as_json(ordered_steps(read(paths[0], "map<string,variant>"))), F.lit(""))
        case "json":
            return as_json(read(paths[0], "variant"))
    raise ValueError(kind)


def project(v: Column, fields: str, read: Reader | None = None) -> list[Column]:
    """The columns that a field table names, read from the variant ``v`` or, where they are many rows, from an opened object."""
    read = read or (lambda path, kind: field(v, f"$.{path}", kind))
    return [column_of(read, kind, paths).alias(name) for name, kind, paths in fields_of(fields)]


def span_text(low: Column, high: Column, unit: Column) -> Column:
    """'2 years', or '2-3 years' where the ends differ; '' without either end."""
    one = high.isNull() | (high == low)
    shown = F.when(one, low.cast("string")).otherwise(F.concat_ws("-", F.coalesce(low.cast("string"), F.lit("")), high.cast("string")))
    return F.when(low.isNull() & high.isNull(), "").otherwise(F.trim(F.concat_ws(" ", shown, unit)))


def college_rows(df: DataFrame, v: str = "v") -> DataFrame:
    """A row for each college node with an id; a description that repeats the admission text is ''."""
    out = df.select(*project(F.col(v), COLLEGE)).where("college_id IS NOT NULL")
    opening = lambda c: F.lower(F.trim(F.left(F.col(c), F.lit(60))))
    repeats = (F.col("description") != "") & (opening("description") == opening("admission_text"))
    return out.withColumn("description", F.when(repeats, "").otherwise(F.col("description")))


def listing_rows(df: DataFrame, page: str, v: str = "v") -> DataFrame:
    """A row for each course of a listing page that belongs to the page's own college; the first of repeated ones."""
    types = members(LISTING, ("instituteId", "duration", "maxDuration", "durationUnit", "maxDurationUnit"))
    cards = field(F.col(v), "$.courseTuples", f"array<{struct_of(types)}>")
    pages = df.select(page, v, whole(field(F.col(v), "$.listingId", "string")).alias("college_id"))  # once for a page, not for each card
    tuples = pages.select(page, "college_id", F.posexplode(cards).alias("_pos", "_t"))
    t = F.col("_t")
    unit = F.coalesce(*(F.nullif(t[k], F.lit("")) for k in ("durationUnit", "maxDurationUnit")), F.lit(""))
    belongs = F.coalesce(whole(t["instituteId"]), "college_id") == F.col("college_id")
    own = tuples.where(F.coalesce(belongs, F.lit(False)))  # no condition on the page follows from it, which would be read twice
    rows = own.select(page, "_pos", "college_id", *project(t, LISTING, reader(t, types)), span_text(whole(t["duration"]), whole(t["maxDuration"]), unit).alias("duration")).where("course_id IS NOT NULL")
    first = Window.partitionBy(page, "college_id", "course_id").orderBy("_pos")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_pos")
    return rows.withColumn("course_slug", F.element_at(F.split("url", "/"), -1))


def detail_rows(df: DataFrame, v: str = "v") -> DataFrame:
    """A row for each course node, with its duration as text."""
    node = F.col(v)
    value, unit = whole(field(node, "$.durationValue", "string")), field(node, "$.durationUnit", "string")
    return df.select(*project(node, DETAIL), span_text(value, F.lit(None).cast("long"), unit).alias("duration"))


def native_fee(text: Column) -> tuple[Column, Column]:
    """(currency, amount) of 'USD 15,000' or '$15K': a leading ISO code, else the first known sign."""
    # Signs and their currencies, longer signs first.
    signs = (("A$", "AUD"), ("C$", "CAD"), ("S$", "SGD"), ("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("¥", "JPY"), ("₹", "INR"))
    code = F.nullif(F.regexp_extract(F.trim(text), "^([A-Z]{3})\\b", 1), F.lit(""))
    sign = reduce(lambda w, s: w.when(F.contains(text, F.lit(s[0])), s[1]), signs, F)
    return F.coalesce(code, sign), scaled_amount(text)


def scaled_amount(text: Column) -> Column:
    """The first number of a text times its unit (k, m, b, lakh, crore), as a whole number."""
    pattern = r"([0-9.]+)\s*(crores?|cr|lakhs?|lacs?|lac|mn|m|b|k|l)?\b"
    t = F.replace(F.lower(text), F.lit(","), F.lit(""))
    unit = F.regexp_extract(t, pattern, 2)
    scale = F.when(unit.startswith("cr"), 10_000_000).when(unit.startswith("l"), 100_000).when(unit == "k", 1000).when(unit.startswith("m"), 1_000_000).when(unit == "b", 1_000_000_000).otherwise(1)
    return F.bround(F.regexp_extract(t, pattern, 1).try_cast("double") * scale).cast("long")


def programme_rows(df: DataFrame, root: str, v: str = "v") -> DataFrame:
    """A row for each programme abroad: months, fees in both currencies, absolute addresses, the country of the university's path."""
    out = df.select(*project(F.col(v), PROGRAMME))
    currency, amount = native_fee(F.col("fee_native_raw"))
    segment = F.lower(F.element_at(F.split(F.ltrim(F.regexp_replace("university_url", "^https?://[^/]*", ""), F.lit("/")), "/"), 1))
    return out.withColumns({
        "duration_months": duration_months(F.col("duration_text")), "fee_currency": currency, "fee_native_amount": amount,
        "fee_inr_amount": scaled_amount(F.col("fee_inr_raw")), "fee_period": F.lit("per_year"),
        "country_code": F.when((segment != "") & (segment != "university"), segment).otherwise(""),
        **{c: absolute_url(F.col(c), root) for c in ("university_url", "program_url", "logo_url")},
    })


def scholarship_amount(text: Column) -> tuple[Column, Column, Column]:
    """(rupees, amount, currency) of '₹1,436,100 ($15,000)'."""
    inr = scaled_amount(F.nullif(F.regexp_extract(text, "₹\\s*([0-9,]+)", 1), F.lit("")))
    currency, amount = native_fee(F.nullif(F.regexp_extract(text, "\\(([^)]+)\\)", 1), F.lit("")))
    return inr, amount, currency


# Members of the children of a record.
BASE_COURSE = """
base_course_id      int       id
name                text:200  name
level               text:40   courseLevel
min_fees            int       minFees
max_fees            int       maxFees
total_seats         int       totalSeats
course_count        int       courseCount
rating              real      courseRating
exams               list:name,examName  exams
"""

RANKING = """
scope               raw       scope
rank                int       rank
rank_out_of         int       rank_out_of
score               raw       score
"""

EXAM_SCORE = """
short_form          raw       short_form
exam_score          raw       exam_score
out_of              raw       exam_out_of_score
"""


def listed(v: Column, path: str, types: dict[str, str] | None = None) -> Column:
    """The items at a path: of a list, or a single object as a list of one. With ``types`` they are opened as structs; what is
    no object is NULL."""
    one = field(v, path, "variant")
    if types:
        kind = struct_of(types)
        return F.coalesce(field(v, path, f"array<{kind}>"), F.when(kind_of(one) == "object", F.array(field(v, path, kind))), F.array().cast(f"array<{kind}>"))
    none = F.array().cast("array<variant>")
    return F.coalesce(field(v, path, "array<variant>"), F.when(kind_of(one) == "object", F.array(one)), none)


def child_rows(df: DataFrame, keys: list[str], path: str, fields: str, v: str = "v") -> DataFrame:
    """A row (keys, fields) for each object of a list."""
    types, item = members(fields), F.col("_item")
    rows = df.select(*keys, F.explode(listed(F.col(v), path, types)).alias("_item")).where(item.isNotNull())
    return rows.select(*keys, *project(item, fields, reader(item, types)))


def keyed_rows(df: DataFrame, keys: list[str], path: str, name: str, fields: str, v: str = "v") -> DataFrame:
    """A row (keys, name, fields) for each object of the lists of a keyed object; ``name`` is the list's key."""
    lists = df.select(*keys, F.explode(field(F.col(v), path, "map<string,variant>")).alias(name, "_list"))
    return child_rows(lists, [*keys, name], "$", fields, "_list")


def ranking_rows(df: DataFrame, keys: list[str], streams: str, v: str = "v") -> DataFrame:
    """A row for each agency, year and stream of a university's rankings; ``streams`` is the key under which an entry
    holds them. An agency that the record doesn't name is ''."""
    own = df.withColumn("_names", field(F.col(v), "$.ranking_data.agencies", "map<string,variant>"))
    entries = own.select(*keys, "_names", F.explode(F.map_values(field(F.col(v), "$.ranking_data.year_wise_data", "map<string,variant>"))).alias("_list"))
    entries = entries.select(*keys, "_names", F.explode(listed(F.col("_list"), "$")).alias("_e"))
    agency, year = (whole(field(F.col("_e"), f"$.{c}", "string")) for c in ("agencyId", "year"))
    rows = entries.select(*keys, "_names", agency.alias("agency_id"), year.alias("year"), F.explode(field(F.col("_e"), f"$.stream['{streams}']", "map<string,variant>")).alias("stream", "_s"))
    name = field(F.try_element_at("_names", F.col("agency_id").cast("string")), "$.name", "string")
    return rows.where(kind_of(F.col("_s")) == "object").select(*keys, "agency_id", F.coalesce(name, F.lit("")).alias("agency"), "year", "stream", *project(F.col("_s"), RANKING))


def base_course_rows(df: DataFrame, key: str, v: str = "v") -> DataFrame:
    """A row for each base course of a college page; a repeated one counts once, one without an id not at all."""
    types, item = members(BASE_COURSE), F.col("_item")
    rows = df.select(key, F.posexplode(listed(F.col(v), "$.baseCourseTuples", types)).alias("_pos", "_item")).select(key, "_pos", *project(item, BASE_COURSE, reader(item, types)))
    first = Window.partitionBy(key, "base_course_id").orderBy("_pos")
    return rows.where("base_course_id is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_pos")
