"""Exports: CSV, JSON lines and size estimates, without long text where asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def for_export(df: DataFrame, heavy: Sequence[str] = ()) -> DataFrame:
    """Nested values as JSON, absent ones as ''."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cell = lambda c: F.to_json(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")
    return df.select(*(F.coalesce(cell(c), F.lit("")).alias(c) for c in df.columns if c not in heavy))


def write_csv(df: DataFrame, path: str, heavy: Sequence[str] = ()) -> None:
    for_export(df, heavy).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def size_estimate(df: DataFrame) -> DataFrame:
    """(n_rows, n_bytes): characters of all cells and a separator for each."""
    cells = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 1 for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(cells), F.lit(0)).cast("long").alias("n_bytes"))
