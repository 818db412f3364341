"""Line-first quality rules, in DataFrame functions only.

Each line meets the punctuation, navigation and boilerplate rules by itself; failing lines go, and a
document that loses too much of its words is rejected. Document-level counts (symbols, repeated
lines, repeated 8-word windows) come beside it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: ASCII white space: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document keeps its place if at least this share of its words is on lines that pass.
MIN_KEPT_SHARE = 0.5
#: Fixed phrases of site furniture, matched in lower case: English, German, French, Spanish.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here to", "sign up for our newsletter",
    "subscribe to our newsletter", "skip to content", "back to top", "share on facebook", "share on twitter",
    "datenschutzerklärung", "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "javascript aktivieren", "newsletter abonnieren", "zum inhalt springen",
    "politique de confidentialité", "tous droits réservés", "mentions légales", "conditions d'utilisation", "activer javascript", "aller au contenu",
    "política de privacidad", "todos los derechos reservados", "aviso legal", "condiciones de uso", "activar javascript", "ir al contenido",
)
#: One of these is in every line that is a sentence or leads to one.
ENDS = r"[.!?…:;。！？]"
LINK = r"https?://|www\."
CAPITALS = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def furniture(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in BOILERPLATE)))


def suspicious(text: Column, lines: Column) -> Column:
    """A text in which no line can fail is not: it has none of the rules' characters and phrases."""
    marks = (F.translate(text, "|»›•#*$%&<>", "") != text) | F.contains(text, F.lit("!!")) | text.rlike(LINK) | furniture(text)
    return marks | F.exists(lines, lambda x: x.rlike(WORD) & (~x.rlike(ENDS) | shouts(x)))


def shouts(line: Column) -> Column:
    return ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (F.regexp_count(line, F.lit(WORD + "+")) >= CAPITALS)


def line_fails(line: Column) -> Column:
    """True if a line breaks one of the rules. Lines without a word never fail: they hold nothing to lose.

    sentence: no mark that ends or introduces one stands in it;
    capitals: five words or more, and no small letter;
    navigation: three or more separators, one for every two words or more; or two links or more, one for every three words;
    punctuation: a quarter of the words carry runs of symbols, or one word in three ends in ``!!``;
    boilerplate: a fixed phrase of site furniture.
    """
    words = F.regexp_count(line, F.lit(WORD + "+"))
    separators = F.regexp_count(line, F.lit(r"[|»›•]"))
    links = F.regexp_count(line, F.lit(LINK))
    symbol_words = F.regexp_count(line, F.lit(r"[#*$%&<>]{2,}"))
    shouted = F.regexp_count(line, F.lit(r"!!"))
    return line.rlike(WORD) & (
        ~line.rlike(ENDS)
        | shouts(line)
        | ((separators >= 3) & (separators * 3 >= words))
        | ((links >= 2) & (links * 3 >= words))
        | (symbol_words * 4 >= words) & (symbol_words > 0)
        | (shouted * 3 >= words) & (shouted > 0)
        | furniture(line)
    )


def repeated_words(words: Column) -> Column:
    """Word positions inside 8-word windows that stand twice or more in the same text."""
    k = WINDOW

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(starts, j + 1) - p, F.lit(k))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def by_sorting(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = let(pairs, lambda s: F.filter(s, lambda x, j: near(s, x, j - 1) | near(s, x, j + 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def of_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(by_sorting(hashes))

    def doubled(each: Column, step: int) -> Column:
        return let(each, lambda x: F.transform(x, lambda h, i: F.xxhash64(h, F.get(x, i + step))))

    def windows(each: Column) -> Column:
        """Hashes of 2, then 4, then 8 words; what begins in the last k-1 words is no whole window."""
        eight = doubled(doubled(doubled(each, 1), 2), 4)
        return F.slice(eight, F.lit(1), F.size(each) - (k - 1))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < k, F.lit(0)).otherwise(let(hashed, lambda each: let(windows(each), of_windows)))


def quality_report(df: DataFrame, text_col: str = "text", min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """``df`` with a struct column ``quality``: counts, ``clean_text`` (failing lines removed) and ``kept``.

    A null text counts as one without words: nothing in it, base_failed, not kept, clean_text ''.
    An input column named quality is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_lines(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(WORD))
        n_dup = let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        passed = F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n")
        return F.struct(n_dup.alias("n_dup_lines"), F.when(suspicious(text, lines), passed).alias("clean_text"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    out = df.withColumn("_gl_words", let(words_of(text), of_words)).withColumn("_gl_lines", let(F.split(text, "\n"), of_lines))
    cleaned = F.col("_gl_lines.clean_text")
    left = F.when(cleaned.isNull(), F.col("_gl_words.n_words")).otherwise(F.regexp_count(cleaned, F.lit(WORD + "+")).cast("long"))
    out = out.withColumn("_gl_left", left)
    failed = (F.col("_gl_words.n_words") < MIN_WORDS) | (
        100 * F.col("_gl_words.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_gl_words.n_words")
    )
    return out.withColumn(
        "quality",
        F.struct(
            "_gl_words.n_words", chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
            "_gl_lines.n_dup_lines", "_gl_words.n_repeat_words", F.col("_gl_left").alias("n_kept_words"),
            failed.alias("base_failed"),
            (~failed & (F.col("_gl_left") >= min_kept_share * F.col("_gl_words.n_words"))).alias("kept"),
            F.coalesce(cleaned, text).alias("clean_text"),
        ),
    ).drop("_gl_words", "_gl_lines", "_gl_left")


def op4_quality(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; a null text has no words and fails the base rules."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")
    return quality_report(docs.select("doc_id", "text")).select("doc_id", *(f"quality.{x}" for x in fields))


def _sql() -> str:
    words = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    count = lambda pattern, of="x": f"len(regexp_extract_all({of}, '{pattern}'))"
    n = count(r"[^\x20\x09-\x0D]+")
    seps, syms, shout, links = count("[|»›•]"), count("[#*$%&<>]{2,}"), count("!!"), count(LINK)
    furniture = " OR ".join("contains(lower(x), '" + p.replace("'", "''") + "')" for p in BOILERPLATE)
    has = lambda pattern: f"regexp_matches(x, '{pattern}')"
    capitals = f"(NOT {has(chr(92) + 'p{Ll}')} AND {has(chr(92) + 'p{Lu}')} AND {n} >= {CAPITALS})"
    fails = (
        f"({has(WORD)} AND (NOT {has(ENDS)} OR {capitals} OR ({seps} >= 3 AND {seps} * 3 >= {n}) OR ({links} >= 2 AND {links} * 3 >= {n})"
        f" OR ({syms} * 4 >= {n} AND {syms} > 0) OR ({shout} * 3 >= {n} AND {shout} > 0) OR {furniture}))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words.format("t")} AS ws, string_split(t, chr(10)) AS ls FROM d),
f AS (SELECT *, array_to_string(list_filter(ls, lambda x: NOT {fails}), chr(10)) AS clean,
        list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS worded FROM w),
win AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n_repeat_words
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
o AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(len(worded) - len(list_distinct(worded)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        CAST({count(r"[^\x20\x09-\x0D]+", "clean")} AS BIGINT) AS n_kept_words FROM f LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_kept_words >= {MIN_KEPT_SHARE} * n_words) AS kept,
  n_kept_words FROM o"""


SQL = _sql()
