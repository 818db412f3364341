"""Queues, set reports, rankings, distributions, completeness and batch scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import missing


def pending(entity: DataFrame, progress: DataFrame, key: str, terminal: Sequence[str] = ("done", "empty")) -> DataFrame:
    """Work that drains itself: entities without a progress row in a terminal state."""
    return entity.join(progress.where(F.col("status").isin(*terminal)).select(key), key, "left_anti")


def cross_source(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of two key sets, their intersection, differences and union."""
    left, right = (x.select(key).where(F.col(key).isNotNull()).distinct().withColumn(n, F.lit(1)) for x, n in ((a, "_a"), (b, "_b")))
    j, has_a, has_b = left.join(right, key, "full_outer"), F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return j.agg(
        F.count_if(has_a).alias("n_a"), F.count_if(has_b).alias("n_b"), F.count_if(has_a & has_b).alias("n_both"),
        F.count_if(has_a & ~has_b).alias("only_a"), F.count_if(has_b & ~has_a).alias("only_b"), F.count(F.lit(1)).alias("n_union"),
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def histogram(df: DataFrame, value: Column, edges: Sequence[tuple[float | None, str]]) -> DataFrame:
    """(bucket, n) ordered by the smallest value; an edge is an exclusive upper bound, None the rest."""
    label = reduce(lambda acc, e: acc.when(value < e[0], e[1]) if e[0] is not None else acc.otherwise(e[1]), edges, F)
    return df.where(value.isNotNull()).groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest")).orderBy("lowest")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, total, percent) of all columns in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(~missing(F.col(c))).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns))
    out = counts.select("total", F.inline(pairs))
    return out.withColumn("percent", F.round(100 * F.col("filled") / F.nullif(F.col("total"), F.lit(0)), 2))


def upper_median(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """(by, median): element n div 2 of each group's sorted values without nulls. A group is only as large as
    its distinct values, which are counted first."""
    counts = df.groupBy(by, F.col(value).alias("_v")).agg(F.count(value).alias("_n"))
    group = Window.partitionBy(by)
    running = counts.withColumn("_to", F.sum("_n").over(group.orderBy("_v"))).withColumn("_all", F.sum("_n").over(group))
    return running.groupBy(by).agg(F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("_v"))).alias(name))


def capped_count(n: Column, cap: int = 10) -> Column:
    return F.when(n >= cap, f"{cap}+").otherwise(n.cast("string"))


def batch_score(n: Column, missing_percent: Column, blanks: Column, min_rows: int = 1, max_percent: float = 100.0) -> Column:
    """0 to 100: too few rows cost 50, missing fees up to 40, blank names up to 20."""
    score = F.lit(100.0) - F.when(n < min_rows, 50.0).otherwise(0.0)
    score = score - F.least(F.lit(40.0), F.greatest(F.lit(0.0), missing_percent - max_percent)) - F.least(F.lit(20.0), blanks.cast("double"))
    return F.round(F.greatest(F.lit(0.0), score), 1)


def guarded_select(spark: SparkSession, sql: str, most: int = 1000, **tables: DataFrame) -> DataFrame:
    """Rows of one SELECT over given tables, at most ``most``; anything else is refused."""
    text = sql.strip()
    if ";" in text or not text.lower().startswith(("select ", "with ")):
        raise ValueError("one SELECT without a semicolon is asked for")
    # a command would run as soon as it is given to the session: the parsed plan has to be a query
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"\{(\w+)\}", r"\1", text)).toString()
    for node in re.findall(r"(?m)^[\s:+-]*'?([A-Z]\w*)", plan):
        if re.search("Command|Statement|^(Insert|Merge|Update|Delete|Overwrite|Append|Create|Replace|Drop|Set|Alter|Truncate|Cache)", node):
            raise ValueError(f"one SELECT is asked for, not {node}")
    return spark.sql(text, **tables).limit(most)


def preview(df: DataFrame, drop: Sequence[str] = (), clip: int = 300) -> DataFrame:
    """All rows without heavy columns, texts clipped."""
    return df.select(*(F.left(c, F.lit(clip)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes if c not in drop))


def slices_within(df: DataFrame, dims: Sequence[str], cap: int) -> DataFrame:
    """(dims, n): slices of at most ``cap`` rows, each split by the next dimension only where it is larger; the last
    dimension isn't split. A dimension that a slice leaves open is NULL there."""
    depth = sum((1 - F.grouping(d) for d in dims), F.lit(0))
    tree = df.rollup(*dims).agg(F.count(F.lit(1)).alias("n"), depth.alias("_depth"))
    above = [F.when(F.col("_depth") > i + 1, F.col(d)) for i, d in enumerate(dims)]  # what the slice above holds fixed
    parent = F.sum("n").over(Window.partitionBy("_depth", *above))
    keep = ((F.col("n") <= cap) | (F.col("_depth") == len(dims))) & ((F.col("_depth") == 0) | (F.col("_parent") > cap))
    return tree.withColumn("_parent", parent).where(keep).select(*dims, "n")


def grown(state: DataFrame, batch: DataFrame, key: str, sets: Sequence[str], newest: Sequence[str], shortest: Sequence[str]) -> DataFrame:
    """A state that only grows: sets are united, the newest and the shortest value of others stay."""
    s, b = state.alias("s"), batch.alias("b")
    joined, of = s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer"), lambda c: (F.col(f"s.{c}"), F.col(f"b.{c}"))
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    short = lambda x, y: F.when(y.isNull() | (F.struct(F.length(x), x) <= F.struct(F.length(y), y)), x).otherwise(y)
    return joined.select(
        F.coalesce(*of(key)).alias(key), *(F.array_sort(F.array_union(*map(none, of(c)))).alias(c) for c in sets), *(F.greatest(*of(c)).alias(c) for c in newest),
        *(F.when(F.col(f"s.{c}").isNull(), F.col(f"b.{c}")).otherwise(short(*of(c))).alias(c) for c in shortest),
    )


def flat_score(n: Column, missing_percent: Column, min_rows: int = 1, max_percent: float = 100.0) -> Column:
    """0 to 100 by flat rules: too few rows cost 50, too many missing values 30."""
    return F.lit(100) - F.when(n < min_rows, 50).otherwise(0) - F.when(missing_percent > max_percent, 30).otherwise(0)
