"""What two inventories lack of one another, by kind; labels matched to codes; scores of jobs before and after promotion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import missing
from .relational import batch_score

BUCKETS = ("matched", "pending", "none")
#: Words in an address that tell what an institution is; the first of them counts.
KINDS = ("iti", "polytechnic", "school", "academy", "training", "coaching", "university", "institute", "college")


def size_bucket(n: Column) -> Column:
    """How many courses a college runs."""
    n = n.cast("string").try_cast("int")
    return F.when(n.isNull(), "(unknown)").when(n <= 0, "0 base courses").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 9, "4-9").otherwise("10+")


def review_bucket(n: Column) -> Column:
    """No value is no review; a text that is no number is unknown."""
    text = F.coalesce(F.nullif(n.cast("string"), F.lit("")), F.lit("0"))
    n = text.try_cast("int")
    return F.when(n.isNull(), "(unknown)").when(n == 0, "no reviews").when(n <= 5, "1-5").when(n <= 25, "6-25").otherwise("26+")


def named(value: Column) -> Column:
    return F.when(missing(F.trim(value.cast("string"))), "(blank)").otherwise(F.trim(value.cast("string")))


def cross_tables(df: DataFrame, sections: Mapping[str, Column], bucket: str = "bucket", top: Mapping[str, int] | None = None) -> DataFrame:
    """(section, value, seen, matched, pending, none, and each bucket's share in percent): a row for each value of each section's
    column, in one pass over ``df``. ``top`` keeps only so many values of a section, the most frequent."""
    cells = F.array(*(F.struct(F.lit(name).alias("section"), c.alias("value")) for name, c in sections.items()))
    return shared(df.select(F.col(bucket).alias("_b"), F.inline(cells)), top or {})


def shared(cells: DataFrame, top: Mapping[str, int]) -> DataFrame:
    """The table of rows (section, value, _b)."""
    held = lambda b: F.count_if(F.col("_b") == b)
    out = cells.groupBy("section", "value").agg(F.count(F.lit(1)).alias("seen"), *(held(b).alias(b) for b in BUCKETS))
    whole = Window.partitionBy("section")  # as many rows as a section has values
    share = lambda b: F.round(100.0 * F.col(b) / F.greatest(F.sum(b).over(whole), F.lit(1)), 1).alias(f"{b}_share")
    out = out.select("*", *(share(b) for b in BUCKETS))
    if top:
        limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in top.items() for x in pair)), F.col("section")), F.lit(1 << 30))
        place = F.row_number().over(whole.orderBy(F.desc("seen"), "value"))
        out = out.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    return out


def taught(df: DataFrame, courses: DataFrame, key: str, name: str, bucket: str = "bucket", top: int = 12) -> DataFrame:
    """The mix of base courses in each bucket: the ``top`` names over all, with their share of the bucket's pairs of college and course."""
    pairs = courses.where(~missing(F.col(name))).select(key, F.col(name).alias("value")).distinct()
    cells = pairs.join(df.select(key, F.col(bucket).alias("_b")), key).select(F.lit("base course").alias("section"), "value", "_b")
    return shared(cells, {"base course": top})


def kind_of_slug(slug: Column, kinds: Sequence[str] = KINDS) -> Column:
    """The first of some words that an address holds anywhere."""
    low = F.lower(F.coalesce(slug, F.lit("")))
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, kinds)), lambda k: F.contains(low, k)), F.lit(0)), F.lit("(other)"))


def slug_profile(df: DataFrame, slug: str, matched: Column, empty: Column, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(side, kind, n, percent): kinds of institutions among matched rows and the others, and how many of each offer nothing."""
    side = F.when(matched, "matched").otherwise("only")
    cells = F.array(F.struct(kind_of_slug(F.col(slug), kinds).alias("kind"), F.lit(1).alias("one")), F.struct(F.lit("no offerings").alias("kind"), F.when(empty, 1).otherwise(0).alias("one")))
    out = df.select(side.alias("side"), F.inline(cells)).groupBy("side", "kind").agg(F.sum("one").alias("n"))
    rows = F.sum(F.when(F.col("kind") != "no offerings", F.col("n")).otherwise(0)).over(Window.partitionBy("side"))  # a row for each kind
    return out.select("side", "kind", "n", F.round(100.0 * F.col("n") / rows, 1).alias("percent"))


def folded(c: Column) -> Column:
    """Letters only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z]", "")


def match_labels(codes: DataFrame, labels: DataFrame, aliases: DataFrame, least: int = 4) -> DataFrame:
    """``codes`` (code) with label, value and stage: a label equal to the code in its letters; else to one of its aliases (code,
    place, alias), the first; else one that begins with the code, if that has ``least`` letters or more; else none.

    ``labels`` (label, value): of equal ones the last by value counts; of several that begin alike, the one that came first. Prefixes
    meet by equality: a label is dealt by its beginnings of the lengths that codes have.
    """
    known = labels.withColumn("k", folded(F.col("label"))).where(F.col("k") != "")
    known = known.groupBy("k").agg(F.max_by(F.struct("label", "value"), F.struct("value", "label")).alias("hit"), F.min("value").alias("came"))
    mine = codes.select(F.col("code"), folded(F.col("code")).alias("c"))
    exact = known.select(F.col("k").alias("c"), F.col("hit").alias("exact"))
    other = aliases.select(folded(F.col("code")).alias("c"), "place", folded(F.col("alias")).alias("k")).join(known, "k").groupBy("c").agg(F.min_by("hit", "place").alias("alias"))
    sizes = mine.where(F.length("c") >= least).select(F.length("c").alias("size")).distinct()
    starts = known.join(F.broadcast(sizes), F.length("k") >= F.col("size")).select(F.left("k", F.col("size")).alias("c"), "came", "k", "hit")  # as many rows as codes have lengths
    starts = starts.groupBy("c").agg(F.min_by("hit", F.struct("came", "k")).alias("prefix"))
    out = mine.join(exact, "c", "left").join(other, "c", "left").join(starts, "c", "left")
    stage = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("prefix").isNotNull(), "prefix").otherwise("none")
    return out.withColumn("_hit", F.coalesce("exact", "alias", "prefix")).select("code", F.col("_hit.label").alias("label"), F.col("_hit.value").alias("value"), stage.alias("stage"))


#: Tables whose rows have a fee, and those whose rows have a name: (columns of which one must hold something).
FEES = {"offerings": ("fees_amount", "total_fees"), "college_courses": ("fees_amount", "total_fees")}
NAMES = {"courses": ("name", "course_name"), "offerings": ("name", "course_name")}


def job_scores(staged: DataFrame, promoted: Mapping[str, DataFrame], min_rows: int = 1, max_missing: float = 100.0, pass_score: float = 70.0) -> DataFrame:
    """(job, source, total, missing_percent, blanks, score, passed) of each job: by its staged payloads (job_id, table_name, payload), or
    where none are left by the rows that it has promoted (tables with source_job_id; a table or column that isn't there counts
    for nothing). A payload that isn't JSON is a row without fee and name."""
    v = F.try_parse_json("payload")
    value = lambda c: F.coalesce(F.try_variant_get(v, f"$.{c}", "string"), F.lit(""))
    holds = lambda columns, of: ~F.forall(F.array(*map(of, columns)), lambda x: x.isin("", "0", "0.0", "false"))

    def of_tables(rules: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
        inside = F.col("table_name").isin(*rules)
        lost = F.lit(False)
        for table, columns in rules.items():
            lost = lost | ((F.col("table_name") == table) & ~holds(columns, value))
        return inside, lost

    (fee, no_fee), (_, no_name) = of_tables(FEES), of_tables(NAMES)
    first = staged.groupBy(F.col("job_id").alias("job")).agg(F.count(F.lit(1)).alias("total"), F.count_if(fee).alias("fees"), F.count_if(no_fee).alias("lost"), F.count_if(no_name).alias("blanks"))
    first = first.withColumn("source", F.lit("staging"))
    rest = None
    for table, df in promoted.items():
        if "source_job_id" not in df.columns:
            continue
        text = lambda c, df=df: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        count = lambda rules, table=table: F.count_if(~holds(rules[table], text)) if table in rules else F.lit(0).cast("long")
        one = df.where("source_job_id is not null").groupBy(F.col("source_job_id").alias("job")).agg(
            F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) if table in FEES else F.lit(0).cast("long")).alias("fees"), count(FEES).alias("lost"), count(NAMES).alias("blanks")
        )
        rest = one if rest is None else rest.unionByName(one)
    if rest is not None:
        rest = rest.groupBy("job").agg(*(F.sum(c).alias(c) for c in ("total", "fees", "lost", "blanks"))).withColumn("source", F.lit("promoted"))
        first = first.unionByName(rest.join(first.select("job"), "job", "left_anti"))
    percent = F.when(F.col("fees") > 0, 100.0 * F.col("lost") / F.col("fees")).otherwise(0.0)
    score = batch_score(F.col("total"), percent, F.col("blanks"), min_rows, max_missing)
    return first.select("job", "source", "total", F.round(percent, 1).alias("missing_percent"), "blanks", score.alias("score"), ((F.col("total") >= min_rows) & (score >= pass_score)).alias("passed"))
