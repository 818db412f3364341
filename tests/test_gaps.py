"""Edges of gap tables, label matching, job scores and sitemap files."""

from pyspark.sql import functions as F

from gleaner.operators import gaps as G
from gleaner.sources import pages as P


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.t for r in df.select("i", column(F.col("v")).alias("t")).orderBy("i").collect()]


def test_buckets(spark):
    assert one(spark, G.size_bucket, [None, "x", "-1", "0", "1", "3", "4", "9", "10"]) == ["(unknown)", "(unknown)", "0 base courses", "0 base courses", "1", "2-3", "4-9", "4-9", "10+"]
    assert one(spark, G.review_bucket, [None, "", "0", "5", "6", "25", "26", "many"]) == ["no reviews", "no reviews", "no reviews", "1-5", "6-25", "6-25", "26+", "(unknown)"]
    assert one(spark, G.named, [None, " ", " a "]) == ["(blank)", "(blank)", "a"]
    assert one(spark, G.kind_of_slug, [None, "x", "City-University-School", "capital"]) == ["(other)", "(other)", "school", "(other)"]


def test_top_values_and_shares(spark):
    df = spark.createDataFrame([("matched", "a"), ("matched", "b"), ("none", "a"), ("pending", None)], "bucket string, v string")
    rows = {r.value: r for r in G.cross_tables(df, {"v": G.named(F.col("v"))}, top={"v": 2}).collect()}
    assert set(rows) == {"a", "(blank)"} and (rows["a"].seen, rows["a"].matched, rows["a"].none, rows["a"].matched_share) == (2, 1, 1, 50.0)
    assert G.cross_tables(df.limit(0), {"v": F.col("v")}).count() == 0


def test_labels(spark):
    codes = spark.createDataFrame([("usa",), ("Germ",), ("ger",), ("fr",), (None,), ("hongkong",)], "code string")
    labels = spark.createDataFrame([("United States", 5), ("Germania", 9), ("Germany", 3), ("F R", 1), ("f.r.", 2), ("", 4), ("Hong-Kong!", 8)], "label string, value int")
    aliases = spark.createDataFrame([("usa", 1, "united states"), ("usa", 0, "america"), ("zz", 0, "Germany")], "code string, place int, alias string")
    got = {r.code: (r.label, r.value, r.stage) for r in G.match_labels(codes, labels, aliases).collect()}
    assert got == {"usa": ("United States", 5, "alias"), "Germ": ("Germany", 3, "prefix"), "ger": (None, None, "none"), "fr": ("f.r.", 2, "exact"), None: (None, None, "none"), "hongkong": ("Hong-Kong!", 8, "exact")}


def test_scores_fall_back_to_promoted_rows(spark):
    staged = spark.createDataFrame([(1, "offerings", '{"fees_amount": 0, "total_fees": "", "name": "x"}'), (1, "offerings", "{"), (1, "courses", '{"course_name": "y"}'), (1, "others", "{}")], "job_id long, table_name string, payload string")
    offerings = spark.createDataFrame([(1, 5, "n"), (2, 0, "n"), (2, 7, None), (None, 0, "")], "source_job_id long, fees_amount int, name string")
    rows = {r.job: tuple(r)[1:] for r in G.job_scores(staged, {"offerings": offerings, "plain": spark.range(3)}, 1, 40.0).collect()}
    assert rows[1] == ("staging", 4, 100.0, 1, 59.0, False)
    assert rows[2] == ("promoted", 2, 50.0, 1, 89.0, True) and set(rows) == {1, 2}


def test_sitemap_files(spark, tmp_path):
    files = {
        "good": "<?xml version='1.0'?><urlset>\n<url><loc> a&amp;b </loc><lastmod>2024</lastmod></url><url><loc>c</loc></url></urlset>",
        "bare": "<urlset><url><loc>d&e=1</loc></url>\n<url><loc>f&amp;g</loc><lastmod> 2025 </lastmod></url></urlset>", "cut": "<urlset><url><loc>h</loc></url><url><loc>i</lo", "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"kind={name}").mkdir()
        (tmp_path / f"kind={name}" / "map.xml").write_text(text)
    got = sorted((r.kind, r["loc"], r.lastmod) for r in P.sitemap_files(spark, [str(tmp_path / f"kind={k}") for k in files], str(tmp_path)).collect())
    assert got == [("bare", "d&e=1", ""), ("bare", "f&g", "2025"), ("cut", "h", ""), ("good", "a&b", "2024"), ("good", "c", "")]
