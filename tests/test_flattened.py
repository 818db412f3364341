"""Flattening goes through all levels in one pass, whatever the payloads hold."""

import json
import random

from pyspark.sql import functions as F

from gleaner.functions import payload as V


def made(rnd, levels):
    k = rnd.random()
    if levels == 0 or k < 0.25:
        return rnd.choice([1, 'a]"{[\\', None, True, 2.5, "{}"])
    if k < 0.6:
        return [made(rnd, levels - 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(["id", "a", "b", "c d"]): made(rnd, levels - 1) for _ in range(rnd.randint(0, 4))}


def inner(x):
    return list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []


def deep(x):
    return 1 + max(map(deep, inner(x)), default=0) if isinstance(x, (dict, list)) else 0


def holders(x):
    if isinstance(x, dict) and "id" in x:
        return [x]
    return [h for y in inner(x) for h in holders(y)]


def test_depth_and_nodes_of_any_payload(spark):
    rnd = random.Random(3)
    docs = [made(rnd, 7) for _ in range(200)] + [[{"a": 'x\\"' * 100_000, "b": [{"id": None}]}]]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i long, t string")
    assert {r.i: r.n for r in df.select("i", V.nesting(F.col("t")).alias("n")).collect()} == {i: deep(d) for i, d in enumerate(docs)}
    out = V.flattened(df.select("i", F.try_parse_json("t").alias("v")), "id")
    got = [(r.i, json.dumps(json.loads(r.j), sort_keys=True)) for r in out.select("i", F.to_json("node").alias("j")).collect()]
    assert sorted(got) == sorted((i, json.dumps(h, sort_keys=True)) for i, d in enumerate(docs) for h in holders(d))
    assert "Union" not in out._jdf.queryExecution().toString()  # a branch for each level would read the payloads again
