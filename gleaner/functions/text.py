"""Column functions: absence, money, durations, match keys, addresses and fingerprints."""

from __future__ import annotations

import html
import html.entities
import json
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that no name is told by.
STOP_WORDS = ("of", "the", "and", "for", "in", "at", "a", "an", "s")


def missing(c: Column) -> Column:
    """NULL and '' are both absent."""
    return c.isNull() | (c.cast("string") == "")


def nonempty(c: Column) -> Column:
    return F.when(~missing(c), c)


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


#: A number and its unit, tried in this order: a fixed value.
FEE = r"([0-9][0-9.]*)\s*(lakhs?|crores?|cr|l|k|thousand)?"


def fee_to_units(text: Column) -> Column:
    """Whole currency units of a fee text such as '₹ 1.5 Lakh'; half-even; NULL if there is no number."""
    t = F.trim(F.regexp_replace(F.lower(text), "[,₹]|inr", ""))
    number, unit = F.regexp_extract(t, FEE, 1), F.regexp_extract(t, FEE, 2)
    scale = F.when(unit.startswith("l"), 100_000).when(unit.startswith("c"), 10_000_000).when(unit.isin("k", "thousand"), 1000).otherwise(1)
    return F.bround(number.try_cast("double") * scale).cast("long")


def clean_fee(text: Column) -> Column:
    """A fee cell as it is shown: dashes are absent, one blank before a bracket, the sign before a bare number."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\(", " ("), r"₹\s+", "₹")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    shown = F.when(t.rlike("^[0-9,]"), F.concat(F.lit("₹"), t)).otherwise(t)
    return F.when(F.trim(F.coalesce(text, F.lit(""))).isin("", "-", "—", "N/A", "NA", "--"), "").otherwise(shown)


def clean_date(text: Column) -> Column:
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(t == "0000-00-00", "").otherwise(t)


# Labels of the streams 1 to 20.
STREAMS = (
    "Agriculture", "Architecture", "Arts", "Aviation", "Commerce", "Computer Applications", "Dental", "Design", "Education", "Engineering",
    "Hotel Management", "Law", "Management", "Mass Communications", "Medical", "Paramedical", "Pharmacy", "Science", "Veterinary Sciences", "Vocational Courses",
)


def stream_name(stream: Column) -> Column:
    """Label of a stream number; an unknown one is named by it, what is no number is ''."""
    n = stream.try_cast("int")
    known = F.when(n >= 1, F.try_element_at(F.array(*map(F.lit, STREAMS)), n))
    return F.when(n.isNull(), "").otherwise(F.coalesce(known, F.concat(F.lit("Stream "), n.cast("string"))))


def plain_tokens(c: Column) -> Column:
    """Distinct words without stop words and numbers; single letters stay single."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$") & ~x.isin(*STOP_WORDS)))


def address_kind(url: Column) -> Column:
    """struct(kind, slug, id, tab) of an address's path: college, college_tab, offering, university, university_sub or other."""
    # Tabs of a college page.
    tabs = ("courses", "fees", "reviews", "admission", "cutoff", "placement", "scholarships", "infrastructure")
    path = F.rtrim(F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z]+://[^/]*", ""), "[?#].*$", ""), F.lit("/"))
    part = lambda pattern, i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    home, sub = r"^/college/([^/]+)-([0-9]+)$", r"^/college/([^/]+)-([0-9]+)/(.+)$"
    offer, uni, uni_sub = r"^/college/[^/]+-[0-9]+/course-([^/]+)-([0-9]+)$", r"^/university/([^/]+)-([0-9]+)$", r"^/university/([^/]+)-([0-9]+)/.+$"
    first = F.element_at(F.split(part(sub, 3), "/"), 1)
    of = lambda kind, p, tab=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), part(p, 1).alias("slug"), part(p, 2).try_cast("long").alias("id"), tab.alias("tab"))
    nothing = F.struct(F.lit("other").alias("kind"), F.lit(None).cast("string").alias("slug"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("tab"))
    return (
        F.when(path.rlike(home), of("college", home)).when(path.rlike(offer), of("offering", offer))
        .when(path.rlike(sub), of("college_tab", sub, F.when(first.isin(*tabs), first).otherwise("other")))
        .when(path.rlike(uni), of("university", uni)).when(path.rlike(uni_sub), of("university_sub", uni_sub)).otherwise(nothing)
    )


def encoded(payload: Column) -> Column:
    """A payload as compact JSON in base 64."""
    return F.base64(F.to_json(payload).cast("binary"))


def duration_months(text: Column) -> Column:
    """Months of '2 years', '6 months' or '10 weeks'; NULL if none of them stands there."""
    of = lambda unit: F.regexp_extract(F.lower(text), rf"([0-9.]+)\s*{unit}", 1).try_cast("double")
    years, months, weeks = of("year"), of("month"), of("week")
    total = F.coalesce(years * 12, F.lit(0)) + F.coalesce(months, F.lit(0)) + F.coalesce(weeks / 4.345, F.lit(0))
    return F.when(years.isNotNull() | months.isNotNull() | weeks.isNotNull(), F.bround(total).cast("int"))


def domain(c: Column) -> Column:
    """Host of an address or mail address without www; NULL if it is no domain."""
    t = F.element_at(F.split(F.trim(F.lower(c)), "@"), -1)
    t = F.regexp_replace(t, "^[a-z]+://", "")
    t = F.regexp_replace(F.regexp_extract(t, "^([^/?:]*)", 1), r"^www\.", "")
    return F.when(F.contains(t, F.lit(".")) & (F.length(t) > 4), t)


def phone_key(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise("")


def shortform_key(c: Column) -> Column:
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(F.length(key) >= 3, key).otherwise("")


def tokens(c: Column) -> Column:
    """Distinct words without stop words and numbers; runs of single letters become one word."""
    raw = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    joined = F.regexp_replace(F.array_join(raw, " "), r"(?<=\b[a-z0-9]) (?=[a-z0-9]\b)", "")
    return F.array_distinct(F.filter(F.split(joined, " "), lambda x: (x != "") & ~x.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def absolute_url(c: Column, root: str) -> Column:
    return F.when(missing(c), "").when(c.startswith("http"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(c, F.lit("/"))))


#: White space as Python's ``str.strip`` knows it.
SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def shortest(x: Column, whole_point: bool) -> Column:
    """The shortest decimal text that is this double again, with an exponent below 1e-4 and, if ``whole_point``, from 1e16 on, where
    whole numbers also get a fraction; else whole numbers are all their digits (past 38 of them, zeros)."""
    tried = [F.format_string(f"%.{p}e", x) for p in (14, 15, 16)]
    text = F.coalesce(*(F.when(t.try_cast("double") == x, t) for t in tried[:2]), tried[2])
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    digits = F.rtrim(F.replace(F.regexp_extract(text, "^-?([0-9.]+)e", 1), F.lit(".")), F.lit("0"))
    power = F.regexp_extract(text, "e([+-][0-9]+)$", 1).try_cast("int")
    first, rest = F.left(digits, F.lit(1)), F.substring(digits, 2, 30)
    fixed = F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(30))))
    mantissa = F.when(rest == "", first).otherwise(F.concat(first, F.lit("."), rest))
    lifted = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
    whole = (F.abs(x) >= 2.0**53) | (x == F.floor(x))  # floor gives a long
    # all digits of a whole number, from three parts that are exact
    size = F.abs(x)
    high = F.floor(size / 2.0**64)
    middle = F.floor((size - high.cast("double") * 2.0**64) / 2.0**32)
    low = F.floor(size - high.cast("double") * 2.0**64 - middle.cast("double") * 2.0**32)
    part = lambda n, unit: n.cast("decimal(19,0)") * F.lit(Decimal(unit))
    exact = (part(high, 2**64) + part(middle, 2**32) + low.cast("decimal(19,0)")).cast("decimal(38,0)").cast("string")
    plain = F.when(size < 1e38, F.concat(F.when(x < 0, "-").otherwise(""), exact)).otherwise(F.format_string("%.0f", x))
    small = F.concat(sign, F.when(power < -4, lifted).otherwise(fixed))
    if whole_point:
        number = F.when(whole & (F.abs(x) < 1e16), F.concat(F.when(x == 0, sign).otherwise(""), plain, F.lit(".0"))).when(power >= 16, F.concat(sign, lifted)).otherwise(small)
    else:
        number = F.when(whole, plain).otherwise(small)
    endless = F.when(F.isnan(x), "NaN" if whole_point else "nan").when(x > 0, "Infinity" if whole_point else "inf").otherwise("-Infinity" if whole_point else "-inf")
    return F.when(x.isNull(), None).when(F.isnan(x) | (F.abs(x) == float("inf")), endless).otherwise(number)


def as_json(c: Column, kind: T.DataType) -> Column:
    """A value as JSON with sorted keys, and one blank after commas and colons; of any depth."""
    if isinstance(kind, T.StructType):
        cells = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), as_json(c[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))
    elif isinstance(kind, T.MapType):
        cell = lambda k: F.concat(as_json(k.cast("string"), T.StringType()), F.lit(": "), as_json(c[k], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), cell), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: as_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.VariantType):
        text = sorted_json(F.to_json(c))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = shortest(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c, True)
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = F.regexp_extract(F.to_json(F.array(c.cast("string"))), r"(?s)^\[(.*)\]$", 1)
    return F.coalesce(text, F.lit("null"))


@F.pandas_udf(T.StringType())
def sorted_json(texts: pd.Series) -> pd.Series:
    """JSON texts with sorted keys: a variant's members are known row by row only."""
    return texts.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False))


def canonical(c: Column, kind: str | T.DataType) -> Column:
    """One text for a value: absent is '', flags are 1/0, whole floats have no fraction and no exponent, other floats are as
    short as they can be, nested values are JSON with sorted keys, texts have no outer white space."""
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.BooleanType):
        text = c.cast("int").cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = shortest(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c, False)
    elif isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        text = F.when(c.isNotNull(), as_json(c, kind))
    else:
        text = F.btrim(c.cast("string"), F.lit(SPACE))
    return F.coalesce(text, F.lit(""))


def entities() -> dict[str, str]:
    """Texts of named references, as they stand after the ampersand, and of the numbers that stand for other characters."""
    return html.entities.html5 | {f"#{k};": html.unescape(f"&#{k};") for k in (*range(32), *range(127, 160))}


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unescaped(c: Column) -> Column:
    """A text with HTML's character references resolved: names, also old ones without a semicolon, and numbers."""
    known = F.from_json(F.lit(json.dumps(entities())), "map<string,string>")
    old = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))

    def resolved(piece: Column, known: Column) -> Column:
        number, hexed, name = (F.regexp_extract(piece, p, 1) for p in ("^#([0-9]{1,9});?", "^#[xX]([0-9a-fA-F]{1,7});?", "^([A-Za-z][A-Za-z0-9]*;)"))
        code = F.when(number != "", number.try_cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
        short = F.regexp_extract(piece, f"^({old})", 1)
        behind = lambda size: F.substring(piece, size + 1, F.length(piece))

        def char(code: Column) -> Column:
            odd = F.try_element_at(known, F.concat(F.lit("#"), code.cast("string"), F.lit(";")))
            return F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").otherwise(F.coalesce(odd, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))

        def told(r: Column) -> Column:
            return (
                F.when(r["code"].isNotNull(), F.concat(char(r["code"]), F.regexp_replace(piece, "^#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,7});?", "")))
                .when(r["named"].isNotNull(), F.concat(r["named"], behind(F.length(r["name"]))))
                .when(r["short"] != "", F.concat(F.try_element_at(known, r["short"]), behind(F.length(r["short"]))))
                .otherwise(F.concat(F.lit("&"), piece))
            )

        one = F.struct(code.alias("code"), name.alias("name"))
        two = once(one, lambda r: F.struct(r["code"].alias("code"), r["name"].alias("name"), F.when(r["name"] != "", F.try_element_at(known, r["name"])).alias("named")))
        return once(once(two, lambda r: r.withField("short", F.when(r["code"].isNull() & r["named"].isNull(), short))), told)

    def joined(r: Column) -> Column:
        later = F.slice(r["pieces"], F.lit(2), F.greatest(F.size(r["pieces"]) - 1, F.lit(0)))
        return F.concat(F.get(r["pieces"], F.lit(0)), F.array_join(F.transform(later, lambda p: resolved(p, r["known"])), ""))

    # Usual references stand for no part of another one, so they are replaced as they are, the ampersand last.
    usual = reduce(lambda t, name: F.replace(t, F.lit(f"&{name}"), F.lit(html.unescape(f"&{name}"))), ("nbsp;", "lt;", "gt;", "quot;", "#39;"), c)
    short_way = F.replace(usual, F.lit("&amp;"), F.lit("&"))
    whole = once(F.struct(F.split(c, "&", -1).alias("pieces"), known.alias("known")), joined)
    others = F.contains(F.replace(usual, F.lit("&amp;"), F.lit("")), F.lit("&"))
    return F.when(~F.contains(c, F.lit("&")), c).when(others, whole).otherwise(short_way)


def fingerprint(kinds: dict[str, str | T.DataType]) -> Column:
    """SHA-1 over name and value of each column, in the order of the names."""
    parts = [x for n in sorted(kinds) for x in (F.lit(n + "\x1f"), canonical(F.col(n), kinds[n]), F.lit("\x1e"))]
    return F.sha1(F.concat(*parts).cast("binary"))
