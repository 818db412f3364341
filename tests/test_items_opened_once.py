"""Items of harvested lists are read once; pages are made once."""

import json

from pyspark.sql import functions as F

import __spark_entry__
from gleaner.functions import records as W

SF = "/root/testdata/sf0.001"


def plan(df):
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    was = conf.get(name)
    conf.set(name, "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.set(name, was)


def parsed(spark, *pages):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(pages)], "page long, j string")
    return df.select("page", F.try_parse_json("j").alias("v"))


def test_base_courses_are_opened_as_structs(spark):
    text = plan(__spark_entry__.queries()["C3_base_courses"](spark, SF))
    assert "try_variant_get(_item" not in text  # before: each field of each item, some of them twice or more
    assert text.count("parseJson") == 1


def test_base_course_items_of_any_kind(spark):
    odd = {"id": "1,002", "name": " <b>x</b> ", "exams": ["A", {"examName": "B"}, {"name": "", "examName": 3}, None, 5, [1], {"z": 1}], "minFees": [1], "courseLevel": {"a": 1}}
    rows = W.base_course_rows(parsed(spark, {"baseCourseTuples": [7, None, odd, "t", dict(odd, name="later"), {"name": "no id"}]}, {"baseCourseTuples": {"id": 9}}, {"baseCourseTuples": "t"}, []), "page").collect()
    got = {(r.page, r.base_course_id): (r.name, r.level, r.min_fees, r.exams) for r in rows}
    assert got == {(0, 1002): ("x", '{"a":1}', None, '["A","B","3","5","[1]"]'), (1, 9): ("", "", None, "")}


def test_listing_pages_are_made_and_read_once(spark):
    text = plan(__spark_entry__.queries()["C3_listing_rows"](spark, SF))
    assert text.count("parseJson") == 1 and text.count("$.listingId") == 1 and text.count("$.courseTuples") == 1
    behind = text[: text.index("Generate posexplode")]
    assert "$.listingId" not in behind  # before: the whole page went with each card, to be read for its id


def test_listing_cards_of_any_kind(spark):
    card = {"courseId": 1, "instituteId": "5", "name": "a &amp;lt; b &amp; c&nbsp;&notit; &AMPd", "courseLevel": {"name": "UG"}, "duration": 2, "maxDuration": "3", "durationUnit": "years", "isOnline": False}
    pages = parsed(spark, {"listingId": 5, "courseTuples": [3, card, dict(card, name="again"), dict(card, courseId=2, instituteId=None, courseLevel="PG"), dict(card, courseId=4, instituteId=6), None]}, {"listingId": None, "courseTuples": [card]}, {"listingId": 5, "courseTuples": {}})
    got = {(r.page, r.college_id, r.course_id): (r.course_name, r.level, r.duration, r.is_online) for r in W.listing_rows(pages, "page").collect()}
    assert got == {(0, 5, 1): ("a &lt; b & c ¬it; &d", "UG", "2-3 years", 0), (0, 5, 2): ("a &lt; b & c ¬it; &d", "PG", "2-3 years", 0)}
