"""Promotion rewrites the partitions that a batch touches, and nothing else."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators.specs import TableSpec
from gleaner.streaming import promote as P

SPEC = TableSpec("things", ("id",), {"id": "bigint", "name": "string", "fee": "double"}, "preserve")


def stage(spark, folder, rows):
    spark.createDataFrame(rows, P.STAGED).coalesce(1).write.mode("append").parquet(folder)


def files(master):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{master}/{P.BUCKET}=*/*.parquet")}


def table(spark, master):
    return sorted((r.id, r.name, r.fee) for r in P.promoted(spark, SPEC, master).collect())


def payload(i, name, fee=None):
    return f'{{"id": {i}, "name": "{name}"' + ("" if fee is None else f', "fee": {fee}') + "}"


def test_untouched_files_stay(spark, tmp_path):
    staged, master, checkpoint = (str(tmp_path / x) for x in ("staged", "master", "checkpoint"))
    assert P.promoted(spark, SPEC, master) is None
    P.seeded(spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name")), SPEC, master, 8)
    before = files(master)
    rows = [(1, "things", payload(5, "five"), 1), (1, "things", payload(5, ""), 2), (1, "things", payload(5, "late", 2.5), 3), (1, "things", "{broken", 4), (1, "things", '{"name": "no key"}', 5), (1, "others", payload(6, "six"), 6)]
    stage(spark, staged, rows)
    P.promote_touched(spark, SPEC, staged, master, checkpoint, buckets=8)
    after = files(master)
    gone, kept = set(before) - set(after), set(before) & set(after)
    assert len({os.path.dirname(f) for f in gone}) == 1 and len(kept) >= 7 and all(before[f] == after[f] for f in kept)
    want = sorted((i, f"n{i}", None) if i != 5 else (5, "late", 2.5) for i in range(100))
    assert table(spark, master) == want
    assert [tuple(r) for r in P.promotions(spark, master).collect()] == [(0, 5, 2, 1, 1)]
    # the stream goes on from its checkpoint: nothing new, nothing written
    P.promote_touched(spark, SPEC, staged, master, checkpoint, buckets=8)
    assert files(master) == after
    # a batch that comes again after a failure changes no row
    P.promote_batch(spark.createDataFrame(rows, P.STAGED), 0, SPEC, master, ["seq"], 8)
    assert table(spark, master) == want and not os.path.exists(f"{master}/_next")


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_oldest_first_equals_one_batch(spark, tmp_path, files_per_batch):
    staged, master = str(tmp_path / "staged"), str(tmp_path / "master")
    for k in range(3):
        stage(spark, staged, [(1, "things", payload(i, f"{k}-{i}", k), 10 * k + i) for i in range(k, 10, k + 1)])
    P.promote_touched(spark, SPEC, staged, master, str(tmp_path / "checkpoint"), buckets=4, files_per_batch=files_per_batch)
    last = {i: max(k for k in range(3) if i in range(k, 10, k + 1)) for i in range(10)}
    assert table(spark, master) == sorted((i, f"{k}-{i}", float(k)) for i, k in last.items())
    assert P.promotions(spark, master).count() == (3 if files_per_batch else 1)
