"""Candidates among names of many words: none is missing, and common words don't multiply them."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import linkage as L


def sets_of(spark, names):
    return spark.createDataFrame([(sorted(x),) for x in {tuple(sorted(n)) for n in names}], "set array<string>")


def counted(right):
    return right.select(F.explode("set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@pytest.mark.parametrize("seed,least,cap", [(1, 0.45, 600), (2, 0.45, 5), (3, 0.45, 1), (4, 0.6, 3), (5, 0.2, 2), (6, 0.9, 2)])
def test_no_similar_pair_is_missing(spark, seed, least, cap):
    rnd = random.Random(seed)
    common, rest = [f"c{i}" for i in range(8)], [f"w{i}" for i in range(60)]

    def name():
        n = rnd.randint(2, 14)
        return set(rnd.sample(common, min(n, rnd.randint(0, 6))) + rnd.sample(rest, max(1, n - 5)))

    right = [name() for _ in range(150)]
    left = [name() for _ in range(40)] + [set(list(x)[: rnd.randint(1, len(x))]) | set(rnd.sample(rest, rnd.randint(0, 4))) for x in right[:80]]
    x, y = sets_of(spark, left), sets_of(spark, right)
    got = {(tuple(r.lt), tuple(r.rt)) for r in L.long_pairs(x, y, counted(y), least, cap).collect()}
    tuples = lambda names: {tuple(sorted(n)) for n in names}
    want = {(a, b) for a in tuples(left) for b in tuples(right) if max(len(a), len(b)) > L.SHORT_SET and len(set(a) & set(b)) >= least * len(set(a) | set(b))}
    assert want and want <= got
    assert all(max(len(a), len(b)) > L.SHORT_SET and set(a) & set(b) for a, b in got)


def candidates(spark, n):
    """Names of four words that all have, and six of a small vocabulary."""
    words = [F.lit(w) for w in ("university", "institute", "college", "technology")]
    more = [F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(500)).cast("string")) for k in range(6)]
    names = spark.range(n).select(F.array_sort(F.array_distinct(F.array(*words, *more))).alias("set")).distinct()
    return L.long_pairs(names, names, counted(names), 0.45, 3).count() / n


def test_candidates_grow_with_the_names(spark):
    few, many = candidates(spark, 4_000), candidates(spark, 32_000)
    assert few < 10 and many < 20  # by single words each of 32,000 names would meet thousands
