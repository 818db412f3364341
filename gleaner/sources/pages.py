"""Readers of harvested payloads: sitemaps, HTML pages, embedded JSON and tables."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unescaped

# What a page says that only checks its visitor.
CHALLENGE_TITLES = ("just a moment", "attention required", "access denied", "security check", "are you a robot", "ddos-guard")
CHALLENGE_TOKENS = ("cf-browser-verification", "__cf_chl_", "cf_chl_opt", "request unsuccessful. incapsula", "please enable cookies and reload the page")


def sitemap_entries(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(loc, lastmod) of each url of a sitemap or an index; a missing lastmod is '' and a cut-off tail loses nothing."""
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>((?:(?!<loc>).)*)"), F.lit(0))
    one = F.explode(blocks).alias("block")
    rest = df.drop(xml).columns
    return df.select(*rest, one).select(
        *rest, F.regexp_extract("block", r"(?is)<loc>\s*([^<]*?)\s*</loc>", 1).alias("loc"),
        F.regexp_extract("block", r"(?is)<lastmod>\s*([^<]*?)\s*</lastmod>", 1).alias("lastmod"),
    )


def script_json(html: Column, script_id: str = "__NEXT_DATA__") -> Column:
    """Text of the JSON in a script element."""
    return F.nullif(F.regexp_extract(html, rf'(?is)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), F.lit(""))


def json_ld(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a href="([^"]*)"'), F.lit(1))


def table_rows(html: Column) -> Column:
    """Rows of the first table as arrays of cell texts."""
    table = F.regexp_extract(html, "(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    strip = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), strip))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\n\r]+", " "))


#: A quoted text, a brace, or a quote that nothing closes.
PIECES = re.compile(r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[{}"']""")


def balanced_object(text: str, marker: str) -> str | None:
    """The object after a marker, by counting braces outside of quoted texts; None if it doesn't end."""
    start = text.find("{", text.find(marker) + len(marker)) if marker in text else -1
    depth = 0
    for m in PIECES.finditer(text, start) if start >= 0 else ():
        if m[0] in "\"'":
            return None
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return text[start : m.end()]
    return None


def script_state(df: DataFrame, html: str, marker: str, out: str = "state") -> DataFrame:
    """``df`` with the object assigned after ``marker``; a regex can't match braces, so it is read in tasks."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else balanced_object(x, marker) for x in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def block_page(html: Column) -> Column:
    """True for a challenge page and for an absent or empty one, by its first 20,000 characters."""
    head = F.left(html, F.lit(20_000))
    heading, low = F.lower(F.regexp_extract(head, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lower(head)
    has = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    blank = F.coalesce(~head.rlike(r"\S"), F.lit(True))
    return blank | has(heading, CHALLENGE_TITLES) | has(low, CHALLENGE_TOKENS)


def of_families(loc: Column, families: Sequence[str]) -> Column:
    """Whether a sitemap's file name begins with one of the wanted families: others need not be read."""
    name = F.lower(F.element_at(F.split(loc, "/"), -1))
    return F.exists(F.array(*map(F.lit, families)), lambda f: F.startswith(name, f))


def unpacked(raw: bytes | None) -> str:
    """Text of a payload that may be gzip, zlib or plain."""
    raw = raw or b""
    try:
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        elif raw[:1] == b"\x78":
            raw = zlib.decompress(raw)
    except (OSError, EOFError, zlib.error):
        pass  # it only looks packed
    return raw.decode("utf-8", "replace")


def decompressed(df: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """``df`` with the text of its binary payloads, in place of them."""
    from pyspark.sql import types as T

    rest = [f for f in df.schema.fields if f.name != content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(map(unpacked, b.column(content).to_pylist()), pa.string())], [*(f.name for f in rest), out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))


def ld_nodes(html: Column) -> Column:
    """The JSON-LD objects of a page as variants: lists and graphs are laid open, what isn't JSON is left out."""
    none = F.array().cast("array<variant>")
    many = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.when(v.isNotNull(), F.array(v)), none)
    return F.flatten(F.transform(json_ld(html), lambda x: many(F.try_parse_json(x))))


def ld_first(html: Column, kind: str) -> Column:
    """The first JSON-LD object of a type."""
    of = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return F.get(F.filter(ld_nodes(html), lambda v: F.coalesce(F.array_contains(of(v), kind), F.lit(False))), F.lit(0))


def named_cells(html: Column, names: dict[str, Sequence[str]]) -> Column:
    """Rows of a page's first table as structs: a column is the first whose heading holds one of its words."""
    rows = table_rows(html)
    heads = F.transform(F.get(rows, F.lit(0)), F.lower)
    at = lambda words: F.array_position(F.transform(heads, lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w))), True)
    cell = lambda row, words: F.try_element_at(row, F.nullif(at(words), F.lit(0)).cast("int"))
    return F.transform(F.slice(rows, 2, 1_000_000), lambda row: F.struct(*(cell(row, words).alias(n) for n, words in names.items())))


def sitemap_files(spark: SparkSession, paths: Sequence[str], base: str | None = None) -> DataFrame:
    """(loc, lastmod, and the partitions below ``base``) of the entries in sitemap files: Spark's XML reader splits a file by entry. A
    file that is no XML to its end, as by a bare ampersand, is read leniently as a whole; a missing lastmod is ''."""
    reader = spark.read.format("xml").option("rowTag", "url").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema("loc string, lastmod string, _bad string")
    df = (reader.option("basePath", base) if base else reader).load(list(paths))
    rest = [c for c in df.columns if c not in ("loc", "lastmod", "_bad")]
    df = df.select(*rest, "loc", "lastmod", "_bad", F.col("_metadata.file_path").alias("_file"))
    bad = df.where("_bad is not null AND loc IS NULL").select("_file", "_bad", *rest).dropDuplicates(["_file"])
    tidy = lambda c: F.trim(F.coalesce(c, F.lit("")))
    good = df.where("_bad is null").join(bad.select("_file"), "_file", "left_anti").select(*rest, tidy(F.col("loc")).alias("loc"), tidy(F.col("lastmod")).alias("lastmod"))
    lenient = sitemap_entries(bad.drop("_file"), "_bad").select(*rest, unescaped(F.col("loc")).alias("loc"), "lastmod")
    return good.unionByName(lenient).where("loc <> ''")
