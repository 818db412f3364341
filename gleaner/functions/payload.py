"""Columns of harvested JSON records, read as variants: null-safe paths, label blocks, ordered steps, shapes."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"OBJECT": "object", "ARRAY": "list", "STRING": "text", "BOOLEAN": "flag", "VOID": "null"}


def field(v: Column, path: str, kind: str) -> Column:
    """The value at a path; NULL where the path is missing or holds another type."""
    return F.try_variant_get(v, path, kind)


def first_text(v: Column, *paths: str) -> Column:
    """The first text at one of the paths that isn't empty."""
    return F.coalesce(*(F.nullif(F.trim(field(v, p, "string")), F.lit("")) for p in paths))


def label_block(entries: Column, labels: dict[str, str]) -> list[Column]:
    """``[{label, value}]`` as one column for each known label; of repeated labels the first counts."""
    of = lambda label: F.filter(entries, lambda e: F.lower(F.trim(e["label"])) == label.lower())
    return [F.nullif(F.try_element_at(of(label), F.lit(1))["value"], F.lit("")).alias(name) for label, name in labels.items()]


def ordered_steps(steps: Column) -> Column:
    """The values of a map keyed '1', '2', '10' in the order of the numbers; other keys come last, by text."""
    keyed = F.transform(F.map_keys(steps), lambda k: F.struct(F.coalesce(k.try_cast("long"), F.lit(2**62)).alias("at"), k.alias("key")))
    return F.transform(F.array_sort(keyed), lambda e: F.try_element_at(steps, e["key"]))


def kind_of(v: Column) -> Column:
    """object, list, text, flag, null or number."""
    head = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return reduce(lambda w, k: w.when(head == k, KINDS[k]), KINDS, F).otherwise("number")


def nodes(df: DataFrame, v: str = "v", depth: int = 3) -> DataFrame:
    """(path, kind, bytes) of each member of the objects in ``v``, down to ``depth`` levels; a row per record and path."""
    spark, level, out = df.sparkSession, df.select(F.lit("").alias("path"), F.col(v).alias("v")), []
    for i in range(depth):
        level = spark.sql("SELECT concat(path, IF(path = '', '', '.'), key) AS path, value AS v FROM {level}, LATERAL variant_explode(v) WHERE key IS NOT NULL", level=level)
        out.append(level.select("path", kind_of(F.col("v")).alias("kind"), F.octet_length(F.to_json("v")).cast("long").alias("bytes")))
        level = level.where(kind_of(F.col("v")) == "object")
    return reduce(DataFrame.union, out)


def located(df: DataFrame, markers: Sequence[str], v: str = "v", depth: int = 3) -> DataFrame:
    """``df`` with ``node``: the first object in ``v``, down to ``depth`` levels, that has all of the marker keys; the
    shallowest one, then the first by its path. Rows without one have a null node."""
    spark, rest = df.sparkSession, [c for c in df.columns if c != v]
    keyed = df.withColumn("_row", F.sha2(F.to_json(v), 256))  # equal payloads have equal nodes
    level, found = keyed.select("_row", F.lit("").alias("path"), F.col(v).alias("v")).dropDuplicates(["_row"]), []
    for i in range(depth + 1):
        keys = F.json_object_keys(F.when(kind_of(F.col("v")) == "object", F.to_json("v")))
        found.append(level.where(F.forall(F.array(*map(F.lit, markers)), lambda m: F.array_contains(keys, m))).select("_row", F.struct(F.lit(i).alias("depth"), "path").alias("at"), F.to_json("v").alias("node")))
        if i < depth:
            level = spark.sql("SELECT _row, concat(path, '.', coalesce(key, lpad(pos, 6, '0'))) AS path, value AS v FROM {level}, LATERAL variant_explode(v)", level=level)
    first = reduce(DataFrame.union, found).groupBy("_row").agg(F.min_by("node", "at").alias("node"))
    return keyed.join(first, "_row", "left").select(*rest, F.try_parse_json("node").alias("node"))


def nesting(text: Column) -> Column:
    """How many brackets of a JSON text are open at once, at most; those in quoted texts don't count."""
    marks = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]++", "")
    for inner in ("", "{}", "{{}}"):  # siblings that are equally deep are as deep as one of them; that leaves little to count
        marks = F.regexp_replace(marks, rf"(?:[\[{{]{re.escape(inner)}[\]}}]){{2,}}+|\[{re.escape(inner)}\]", f"{{{inner}}}")
    step = lambda a, x: F.struct((a["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(x.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda x: x != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def flattened(df: DataFrame, key: str, v: str = "v", depth: int | None = None) -> DataFrame:
    """A row (..., node) for each object that holds ``key``, however lists and objects are nested around it. Without a
    ``depth`` the deepest payload is looked for first, so that none is cut."""
    if depth is None:
        depth = df.agg(F.coalesce(F.max(nesting(F.to_json(v))), F.lit(0))).first()[0]
    spark, rest = df.sparkSession, [c for c in df.columns if c != v]
    level = df.select(*rest, F.col(v).alias("v"), holding(F.col(v), key).alias("_held"))
    names = ", ".join(f"`{c}`" for c in rest)
    for _ in range(depth):  # what holds the key stays as it is; one pass goes through all levels
        level = spark.sql(f"SELECT {names}, IF(_held, v, NULL) AS _kept, value AS _value, _held FROM {{level}}, LATERAL variant_explode_outer(IF(_held, NULL, v))", level=level)
        level = level.where("_held OR _value IS NOT NULL").select(*rest, F.coalesce("_kept", "_value").alias("v"), (F.col("_held") | holding(F.col("_value"), key)).alias("_held"))
    return level.where("_held").select(*rest, F.col("v").alias("node"))


def holding(v: Column, key: str) -> Column:
    """Whether a variant is an object with a key, whatever its value."""
    if re.fullmatch(r"[^\"?]+", key):
        return field(v, f'$["{key}"]', "variant").isNotNull()
    return F.coalesce(F.array_contains(F.json_object_keys(F.when(kind_of(v) == "object", F.to_json(v))), key), F.lit(False))


def names_joined(v: Column) -> Column:
    """A list of texts or of objects with a name, or one text, as distinct names joined by commas."""
    one = lambda x: F.trim(F.coalesce(F.when(kind_of(x) == "object", field(x, "$.name", "string")).otherwise(field(x, "$", "string")), F.lit("")))
    many = F.array_distinct(F.filter(F.transform(field(v, "$", "array<variant>"), one), lambda x: x != ""))
    return F.when(kind_of(v) == "list", F.array_join(many, ", ")).when(kind_of(v) == "text", F.trim(field(v, "$", "string"))).otherwise("")


@F.pandas_udf(T.StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """JSON of Python literals (quotes, nesting, tuples and None read as Python reads them); null for what is none."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(ast.literal_eval(text.strip()), ensure_ascii=False, allow_nan=False)
        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
            return None

    return texts.map(one)


def repaired(text: Column) -> Column:
    """A stored object as a variant, whether it was stored as JSON or as a Python literal. Only what isn't JSON goes to Python."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(literal_json(F.when(F.try_parse_json(text).isNull(), text))))
