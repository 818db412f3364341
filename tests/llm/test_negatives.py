"""Hard negatives against all products, and the parts of the search."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import negatives as ng

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    """All scores of all anchors."""
    kept = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(x)) for x in vector]))
    last = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (i, label, vector) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), j, other, b) for b, (j, other, v) in enumerate(kept)]
        near = sorted(((s, j) for s, j, other, b in scored if other == label and b != a), key=lambda x: last(*x))[:5]
        far = sorted(((s, j) for s, j, other, b in scored if other != label), key=lambda x: last(*x))
        for p, j in near:
            hard = [(s, n) for s, n in far if 30 * p <= 100 * s <= 90 * p][:10]
            out += [(i, j, r, n, p, s) for r, (s, n) in enumerate(hard, 1)]
    return sorted(out, key=str)


def check(df):
    have = sorted((tuple(r) for r in ng.op11_hard_negatives(df).collect()), key=str)
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert have == want
    return want


def test_given_vectors(spark):
    assert check(spark.read.parquet(f"{SF}/embeddings.parquet"))


def test_many_groups_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ng, "LEAST_GROUP", 40)
    monkeypatch.setattr(ng, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ng, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(ng, "ANCHORS_AT_ONCE", 3)
    rnd = random.Random(5)
    hot = [0.25, -0.5, 0.125]
    rows = [(i, hot if i % 3 == 0 else [rnd.uniform(-1, 1) for _ in range(3)], rnd.randint(0, 2)) for i in range(2_000)]
    assert check(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "group", "vector", "rank", "score")}))


def test_odd_rows(spark):
    rnd = random.Random(6)
    rows = [(100 * i, [rnd.uniform(-3, 3) for _ in range(rnd.choice((4, 4, 2)))], rnd.randint(0, 1)) for i in range(30)]
    rows += [(None, [2.0, 2.0, 2.0, 2.0], 1), (None, [2.0, 2.0, 2.0, 1.0], 0), (5, None, 1), (6, [1.0, None], 1), (8, [float("nan")], 1), (9, [float("inf")], 0), (10, [1.0], None), (200, [], 1)]
    rows += [(1_000_100, [1e6, -1e6, 1e6, 5.0], 1), (1_000_101, [1e6, -1e6, 1e6, 4.0], 1), (1_000_102, [5e5, -5e5, 5e5, 4.0], 0)]
    assert check(spark.createDataFrame(rows, SCHEMA))
    assert ng.op11_hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert check(spark.createDataFrame([(0, [0.5], 1), (1, [0.5], 1)], SCHEMA)) == []


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.5, 0.5], 1), (3, [0.5, 0.0], 2), (3, [0.5, 0.0], 2)]
    assert len(check(spark.createDataFrame(rows, SCHEMA))) > 0


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    side = 1 << bits
    cells = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1).T
    walk = cells[np.argsort(np.array(ng.hilbert_keys(cells, bits), dtype=object))]
    assert len(set(ng.hilbert_keys(cells, bits))) == side**dims
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 6))
    vectors = [c + rng.integers(-9, 10, (50, 6)) for c in centres]
    low, high = (np.array([f(v, axis=0) for v in vectors]) for f in (np.min, np.max))
    a = np.concatenate([v[:2] for v in vectors])
    least, most = ng.bounds(a, low, high)
    for k, v in enumerate(vectors):
        s = ng.products(a, v)
        assert (s >= least[:, [k]]).all() and (s <= most[:, [k]]).all()
    best = np.array([max(ng.products(a[[i]], v).max() for v in vectors) for i in range(len(a))])
    assert (most >= best[:, None]).sum() < 0.3 * most.size  # the others need not be read
    wide = np.array([[1 << 40, -(1 << 40)]])
    with pytest.raises(OverflowError):
        ng.products(wide, wide)
