"""Linking two inventories: identity keys, short forms, blocked name similarity, evidence and conflicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, missing, nonempty, tokens

#: Strength of evidence, weakest first.
TIERS = ("name", "short_form", "email", "phone", "website")
IDENTITY = ("website", "phone", "email")
#: Token sets of up to so many words are joined by their subsets, larger ones by rare prefixes.
SHORT_SET = 8


def once(df: DataFrame) -> DataFrame:
    """``df`` made now, and read by all that follows: from the checkpoint folder or, without one, from where it was made."""
    kept = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    return df.checkpoint() if kept else df.localCheckpoint()


def one_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """An inventory from two tables of (id, name, city, ...): the longest name, else the first that isn't empty."""
    rest = [c for c in a.columns if c not in ("id", "name")]
    x, y = (df.select("id", *(F.col(c).alias(f"{p}_{c}") for c in ("name", *rest))) for df, p in ((a, "x"), (b, "y")))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    name = F.when(size(F.col("x_name")) >= size(F.col("y_name")), F.col("x_name")).otherwise(F.col("y_name"))
    first = (F.coalesce(nonempty(F.col(f"x_{c}")), nonempty(F.col(f"y_{c}"))).alias(c) for c in rest)
    return x.join(y, "id", "full_outer").select("id", name.alias("name"), *first)


def key_pairs(left: DataFrame, right: DataFrame, key: str, tier: str, most_sharers: int = 3) -> DataFrame:
    """(l_id, r_id, tier, score, verdict, value): equal keys, unless over ``most_sharers`` rows of a side share one.

    Counting before joining keeps a hot key from pairing everything that holds it.
    """

    def rare(df: DataFrame, side: str) -> DataFrame:
        keyed = df.where(F.coalesce(F.col(key), F.lit("")) != "").select(F.col("id").alias(f"{side}_id"), F.col(key).alias("k"))
        few = keyed.groupBy("k").agg(F.count(F.lit(1)).alias(f"{side}_n")).where(F.col(f"{side}_n") <= most_sharers)
        return keyed.join(few, "k")

    pairs = rare(left, "l").join(rare(right, "r"), "k")
    score = F.when(F.col("r_n") == 1, 1.0).otherwise(0.9)
    return pairs.select("l_id", "r_id", F.lit(tier).alias("tier"), score.alias("score"), F.lit("yes").alias("verdict"), F.col("k").alias("value"))


def short_form_pairs(left: DataFrame, right: DataFrame, most: int = 8) -> DataFrame:
    """Pairs of one ``short_form`` whose cities share a word: the first ``most`` right rows of each left row.

    Of each short form and word only the first right rows can be among them, so no more are joined.
    """
    word = lambda df, side: df.where(~missing(F.col("short_form"))).select(F.col("id").alias(side), F.col("short_form").alias("k"), F.explode(tokens(F.col("city"))).alias("word"))
    first = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("r_id"))).where(F.col("_n") <= most).drop("_n")
    pairs = word(left, "l_id").join(first(word(right, "r_id"), ["k", "word"]), ["k", "word"]).select("l_id", "r_id", "k").distinct()
    return first(pairs, ["l_id"]).select("l_id", "r_id", F.lit("short_form").alias("tier"), F.lit(0.95).alias("score"), F.lit("yes").alias("verdict"), F.col("k").alias("value"))


def subsets(words: Column, least: float) -> Column:
    """Subsets of sorted words that hold at least the share ``least`` of them."""
    masks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(words)) - 1), lambda m: F.bit_count(m) >= least * F.size(words))
    return F.transform(masks, lambda m: F.filter(words, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1))


def opened_blocks(asked: DataFrame, right: DataFrame, df: DataFrame, cap: int) -> DataFrame:
    """(lt, b) of (lt): the blocks that are opened, [(block, token)]: of the three rarest words, rarest first, until
    more than ``cap`` distinct right rows have been seen."""
    ranked = asked.select("lt", F.explode("lt").alias("token")).join(df, "token", "left").fillna(0, ["df"])
    ranked = ranked.withColumn("block", F.row_number().over(Window.partitionBy("lt").orderBy("df", "token"))).where("block <= 3")
    rows = ranked.groupBy("lt").agg(F.array_sort(F.collect_list(F.struct("block", "token", "df"))).alias("b"))
    rows = rows.withColumn("t1", F.get("b", F.lit(0))).withColumn("t2", F.get("b", F.lit(1)))
    # both words' blocks are small, but not together: how many right rows are in both decides
    close = (F.col("t1.df") <= cap) & (F.col("t2.df") <= cap) & (F.col("t1.df") + F.col("t2.df") > cap)
    pairs = rows.where(close).select(F.col("t1.token").alias("x"), F.col("t2.token").alias("y")).distinct()
    both = pairs.join(right.select("n", "rt", F.explode("rt").alias("x")), "x").where(F.array_contains("rt", F.col("y"))).groupBy("x", "y").agg(F.sum("n").alias("both"))
    rows = rows.join(both, (F.col("t1.token") == F.col("x")) & (F.col("t2.token") == F.col("y")), "left")
    second = F.col("t1.df") <= cap
    third = second & (F.col("t1.df") + F.col("t2.df") - F.coalesce("both", F.lit(0)) <= cap)
    keep = F.filter("b", lambda x: (x["block"] == 1) | ((x["block"] == 2) & second) | ((x["block"] == 3) & third))
    return rows.select("lt", F.transform(keep, lambda x: F.struct(x["block"].alias("block"), x["token"].alias("token"))).alias("b"))


def long_pairs(left: DataFrame, right: DataFrame, df: DataFrame, least: float, cap: int) -> DataFrame:
    """(lt, rt): candidates among two tables of distinct word sets (``set``) that have a set of more than ``SHORT_SET`` words; no
    pair of a Jaccard similarity of ``least`` or more is missing.

    Words are sorted by their number of right rows, rarest first. Two sizes tell how many words such a pair shares at least, so
    its first k common words are among the first (size - that number + k) of each: a set is dealt for each size that a
    partner may have. If the first common word is in at most ``cap`` right rows, it makes the pair; if not, the first two make it
    together, and where these are in more than ``cap`` sets, the first three. What is left behind the last of these words
    rules pairs out before their words are compared.
    """
    fewest = math.ceil(least * (SHORT_SET + 1) - 1e-9)
    levels = min(3, max(1, fewest))

    def sizes_of(sets: DataFrame) -> Column:
        return F.array(*(F.lit(n) for (n,) in sets.select(F.size("set")).distinct().collect()))  # as many as the longest name has words

    def ordered(sets: DataFrame, others: Column) -> DataFrame:
        words = sets.select("set", F.explode("set").alias("token")).join(df, "token", "left").fillna(0, ["df"])
        words = words.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("w"), F.count(F.lit(1)).cast("int").alias("n"))
        words = words.select("*", F.explode(others).alias("m")).where((F.greatest("n", "m") > SHORT_SET) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9))
        return words.withColumn("must", F.ceil(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9).cast("int"))

    def first(k: int) -> Column:
        """Words among which the first ``k`` common ones are, with their places."""
        return F.transform(F.slice("w", F.lit(1), F.least(F.col("n"), F.col("n") - F.col("must") + k)), lambda x, i: F.struct(i.alias("at"), x["token"].alias("token"), (x["df"] > cap).alias("common")))

    def once(sets: DataFrame) -> DataFrame:
        word = sets.select("set", "n", "m", F.explode(first(1)).alias("x"))
        return (word if levels == 1 else word.where("not x.common")).select("set", "n", "m", "x.at", F.col("x.token").alias("key"))

    def later(k: int, at: Column) -> Column:
        """Common words behind a place."""
        return F.filter(first(k), lambda x: x["common"] & (x["at"] > at))

    def twice(sets: DataFrame) -> DataFrame:
        out = sets.select("*", F.explode(F.filter(first(2), lambda x: x["common"])).alias("x")).select("*", F.explode(later(2, F.col("x.at"))).alias("y"))
        return out.withColumn("key", F.concat_ws(" ", "x.token", "y.token"))

    def thrice(both: DataFrame) -> DataFrame:
        return both.select("set", "n", "m", "key", F.explode(later(3, F.col("y.at"))).alias("z")).select("set", "n", "m", "z.at", F.concat_ws(" ", "key", "z.token").alias("key"))

    def joined(x: DataFrame, y: DataFrame, k: int) -> DataFrame:
        x = x.select(F.col("set").alias("lt"), F.col("n").alias("ln"), F.col("m").alias("rn"), F.col("at").alias("la"), "key")
        y = y.select(F.col("set").alias("rt"), F.col("n").alias("rn"), F.col("m").alias("ln"), F.col("at").alias("ra"), "key")
        room = k - 1 + F.least(F.col("ln") - F.col("la"), F.col("rn") - F.col("ra"))
        return x.join(y, ["key", "ln", "rn"]).where(room >= least / (1 + least) * (F.col("ln") + F.col("rn")) - 1e-9).select("lt", "rt")

    x, y = ordered(left, sizes_of(right)), ordered(right, sizes_of(left))
    out = joined(once(x), once(y), 1)
    if levels > 1:
        xs, ys = twice(x), twice(y)
        if levels > 2:
            many = ys.groupBy("key", "n", "m").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > cap).select("key", F.col("n").alias("right"), F.col("m").alias("left"))
            on = lambda df, n, m: (df["key"] == many["key"]) & (df["n"] == many[n]) & (df["m"] == many[m])
            split = lambda how: (xs.join(many, on(xs, "left", "right"), how), ys.join(many, on(ys, "right", "left"), how))
            threes, (xs, ys) = split("left_semi"), split("left_anti")
            out = out.union(joined(thrice(threes[0]), thrice(threes[1]), 3))
        flat = lambda both: both.select("set", "n", "m", F.col("y.at").alias("at"), "key")
        out = out.union(joined(flat(xs), flat(ys), 2))
    return out.distinct()


def best_by_name(left: DataFrame, right: DataFrame, cap: int = 600, least: float = 0.45, sure: float = 0.85) -> DataFrame:
    """The most similar right row of each left row among the blocks of its three rarest name tokens, at a similarity
    of ``least`` or more; of equal ones that of the earliest block, then of the smallest id.

    No pair is made through a common word. Rows of one token set are one entry. Two sets of a similarity of ``least``
    share a subset of that share of each; so each entry is dealt by its subsets, a subset keeps the smallest
    right id of each size, and the largest shared subset gives the similarity itself. Pairs with a set of more
    than ``SHORT_SET`` words are found by :func:`long_pairs`.

    Many steps need the word sets, so they are made once, and words are looked for once in each distinct name. Empty
    sets go only then: as a condition on the names it would be asked of every row that is read.
    """
    words = F.array_sort(tokens(F.col("name")))
    l = once(left.select("name").distinct().select("name", words.alias("lt"))).where("size(lt) > 0")  # noqa: E741
    r = right.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("r_id"))
    r = once(r.groupBy(words.alias("rt")).agg(F.sum("n").alias("n"), F.min("r_id").alias("r_id"))).where("size(rt) > 0")
    df = r.select("n", F.explode("rt").alias("token")).groupBy("token").agg(F.sum("n").alias("df"))
    asked = once(opened_blocks(l.select("lt").distinct(), r, df, cap))
    block = lambda shared: F.array_min(F.transform(F.filter("b", lambda x: F.array_contains(shared, x["token"])), lambda x: x["block"]))
    score = lambda both, n: F.round(both / (F.size("lt") + n - both), 6)

    few = r.where(F.size("rt") <= SHORT_SET).select("r_id", F.size("rt").alias("rn"), F.explode(subsets(F.col("rt"), least)).alias("part"))
    parts = asked.where(F.size("lt") <= SHORT_SET).select("lt", "b", F.explode(subsets(F.col("lt"), least)).alias("part"))
    found = parts.join(few.groupBy("part", "rn").agg(F.min("r_id").alias("r_id")), "part")
    found = found.select("lt", "r_id", score(F.size("part"), F.col("rn")).alias("score"), block(F.col("part")).alias("block"))

    pairs = long_pairs(asked.select(F.col("lt").alias("set")), r.select(F.col("rt").alias("set")), df, least, cap)
    pairs = pairs.join(asked, "lt").join(r.select("rt", "r_id"), "rt").withColumn("shared", F.array_intersect("lt", "rt"))
    found = found.union(pairs.select("lt", "r_id", score(F.size("shared"), F.size("rt")).alias("score"), block(F.col("shared")).alias("block")))

    best = found.where((F.col("score") >= least) & F.col("block").isNotNull()).groupBy("lt").agg(F.min(F.struct(-F.col("score"), "block", "r_id")).alias("x"))
    named = l.join(best.select("lt", (-F.col("x.col1")).alias("score"), "x.r_id"), "lt").drop("lt")
    out = left.select(F.col("id").alias("l_id"), "name").join(named, "name")
    verdict = F.when(F.col("score") >= sure, "yes").otherwise("pending")
    return out.select("l_id", "r_id", F.lit("name").alias("tier"), "score", verdict.alias("verdict"), F.lit(None).cast("string").alias("value"))


def merge_evidence(pairs: DataFrame) -> DataFrame:
    """One row a pair: the strongest tier, the highest score, a sticky yes, the other tiers, and the values of
    its identity tiers."""
    rank = F.array_position(F.lit(list(TIERS)), F.col("tier"))
    out = pairs.groupBy("l_id", "r_id").agg(
        F.max_by("tier", rank).alias("tier"), F.max("score").alias("score"),
        F.when(F.bool_or(F.col("verdict") == "yes"), "yes").otherwise("pending").alias("verdict"), F.collect_set("tier").alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("tier").isin(*IDENTITY), F.col("value")))).alias("evidence"),
    )
    also = F.array_sort(F.array_except("_all", F.array("tier")))
    return out.select("l_id", "r_id", "tier", "score", "verdict", F.array_join(also, ",").alias("also"), "evidence")


def conflicts(pairs: DataFrame, names: DataFrame, same: float = 0.8) -> DataFrame:
    """Right rows with several claimants: (r_id, n_claims, kind).

    Claims by key are capped, those by name are alike in their words; a group is as large as its distinct names.
    """
    claims = pairs.where("verdict = 'yes'").join(names.select(F.col("id").alias("l_id"), "name"), "l_id").withColumn("_v", F.get("evidence", F.lit(0)))
    claims = claims.withColumn("_n", F.struct(F.lower("name").alias("name"), tokens(F.col("name")).alias("bag")))
    groups = claims.groupBy("r_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.collect_set("_n").alias("ns"), F.min(F.size("evidence")).alias("least"), F.max(F.size("evidence")).alias("most"),
        F.min("_v").alias("v1"), F.max("_v").alias("v2"),
    ).where("n_claims > 1")
    groups = groups.withColumns({"bags": F.transform("ns", lambda x: x["bag"]), "ns": F.transform("ns", lambda x: x["name"])})
    bags = F.col("bags")
    alike = F.forall(F.transform(bags, lambda x: F.array_min(F.transform(bags, lambda y: jaccard(x, y)))), lambda m: m >= same)
    shared = (F.col("least") == 1) & (F.col("most") == 1) & (F.col("v1") == F.col("v2"))
    inside = F.exists("ns", lambda x: F.exists("ns", lambda y: (x != y) & F.contains(y, x)))
    kind = F.when(alike, "duplicate").when(shared, "shared-signal").when(inside, "parent-child").otherwise("ambiguous")
    return groups.select("r_id", "n_claims", kind.alias("kind"))


def overlap(left: DataFrame, right: DataFrame, strict: float = 0.99, loose: float = 0.6) -> DataFrame:
    """(side, n, n_strict, n_loose): rows of each side whose best name partner on the other side is so similar;
    the sides ``left-self`` and ``right-self`` match an inventory with itself, as a control of the method.

    Rows with one set of name tokens are one entry with a count, so that a common name costs no more than a rare one. The
    entries are made once, from distinct names.
    """
    key = F.array_sort(tokens(F.col("name")))

    def entries(df: DataFrame) -> DataFrame:
        names = df.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        return once(names.groupBy(F.array_join(key, " ").alias("name")).agg(F.sum("n").alias("n"), F.min("id").alias("id")))

    a, b = entries(left), entries(right)

    def measured(side: str, x: DataFrame, y: DataFrame) -> DataFrame:
        best = best_by_name(x, y, least=loose).select(F.col("l_id").alias("id"), "score")
        held = lambda least: F.coalesce(F.sum(F.when(F.col("score") >= least, F.col("n"))), F.lit(0))
        return x.join(best, "id", "left").agg(F.lit(side).alias("side"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), held(strict).alias("n_strict"), held(loose).alias("n_loose"))

    return measured("left", a, b).union(measured("right", b, a)).union(measured("left-self", a, a)).union(measured("right-self", b, b))
