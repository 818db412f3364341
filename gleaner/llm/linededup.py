"""Site-relative line frequency, in DataFrame functions only.

A page is a distinct text of a host. A line that stands on more than ``max_ratio`` of its host's
pages, and on ``min_pages`` of them at least, is boilerplate and leaves every text of that host.

At scale: only 64-bit hashes of lines are shuffled, once for each page and line, and counted with
partial sums, so neither a host nor a line that holds a third of all rows meets in one task. A host
has at most (mean lines a page / max_ratio) boilerplate lines, so their list is short whatever the
number of pages. The lists are counted: up to ``BROADCAST_LINES`` hashes they go out to the texts, which then cross no
exchange; longer ones are joined by host and a part of the text's hash, so that a large host has many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_RATIO = 0.08
MIN_PAGES = 5
BROADCAST_LINES = 1_000_000
#: Parts of a host where its list is joined by a shuffle.
PARTS = 64
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def named_host(host_col: str) -> Column:
    """A host's name after ``h``; a null host, which is a host of its own, is the empty text."""
    return F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))


def boilerplate_lines(
    df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(_gl_host, line, pages, host_pages): hashes of the lines over the ratio. Lines without a word don't count."""
    host, text = named_host(host_col), F.coalesce(F.col(text_col), F.lit(""))
    page = df.select(host.alias("_gl_host"), F.xxhash64(text).alias("_gl_page"), text.alias("_gl_text"))
    totals = page.groupBy("_gl_host", "_gl_page").count().groupBy("_gl_host").agg(F.count(F.lit(1)).alias("host_pages"))
    worded = F.transform(F.filter(_lines(F.col("_gl_text")), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x))
    seen = page.select("_gl_host", "_gl_page", F.explode(F.array_distinct(worded)).alias("line"))
    pages = (
        seen.groupBy("_gl_host", "line", "_gl_page").agg(F.lit(1).alias("_gl_one"))  # a copied page counts once
        .groupBy("_gl_host", "line").agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return pages.join(totals, "_gl_host").where(F.col("pages") > max_ratio * F.col("host_pages"))


def drop_boilerplate(
    df: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """``df`` with boilerplate lines gone from ``text_col`` and their number in ``n_dropped_lines``.

    Every row stays, even if no line of it does. Null texts stay null with 0 dropped lines; a null
    host is a host of its own. An input column named n_dropped_lines, in any case, is replaced.
    """
    found = checkpointed(boilerplate_lines(df, host_col, text_col, max_ratio, min_pages).select("_gl_host", "line"))
    lists = found.groupBy("_gl_host").agg(F.collect_list("line").alias("_gl_drop"))
    few = found.limit(broadcast_lines + 1).count() <= broadcast_lines
    host, part = named_host(host_col), F.pmod(F.xxhash64(text_col, F.lit(5)), F.lit(PARTS)).cast("int")
    part = F.lit(0) if few else part
    lists = F.broadcast(lists.withColumn("_gl_part", F.lit(0))) if few else lists.withColumn("_gl_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    lines = F.split(F.col(text_col), "\n")
    drops = lambda x: F.array_contains(F.col("_gl_drop"), F.xxhash64(x)) & x.rlike(WORD)
    left = F.when(F.col("_gl_drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~drops(x)))
    kept = [c for c in df.columns if c.lower() != "n_dropped_lines"]
    out = df.select(*kept).withColumn("_gl_host", host).withColumn("_gl_part", part)
    out = out.join(lists, ["_gl_host", "_gl_part"], "left").withColumn("_gl_left", left)
    gone = F.coalesce(F.size(lines) - F.size("_gl_left"), F.lit(0)).cast("long")
    return out.select(
        *(F.array_join("_gl_left", "\n").alias(c) if c == text_col else F.col(c) for c in kept),
        gone.alias("n_dropped_lines"),
    )


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; a null text stays null, a null source is a host of its own."""
    return drop_boilerplate(docs.select("doc_id", "source", "text"))


SQL = f"""
WITH d AS (SELECT doc_id, source, text, coalesce('h' || source, '') AS h, coalesce(text, '') AS t FROM documents),
p AS (SELECT DISTINCT h, t FROM d),
n AS (SELECT h, count(*) AS host_pages FROM p GROUP BY h),
l AS (SELECT DISTINCT h, t, unnest(string_split(t, chr(10))) AS line FROM p),
b AS (SELECT h, line FROM (SELECT h, line, count(*) AS pages FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY h, line) JOIN n USING (h)
      WHERE pages >= {MIN_PAGES} AND pages > {MAX_RATIO} * host_pages),
g AS (SELECT h, list(line) AS drops FROM b GROUP BY h),
o AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(drops, x), false)) AS kept FROM d LEFT JOIN g USING (h))
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(string_split(text, chr(10))) - len(kept), 0) AS BIGINT) AS n_dropped_lines FROM o"""
