"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets by a seeded hash; the bucket count follows from the
total bytes, so a bucket fits in a worker's memory at any input size. Pass two makes a seeded
Fisher-Yates permutation of each bucket's places and puts every record of the bucket to its place. Buckets
laid end to end give every record one global position; shards are equal runs of positions, so their
row counts differ by one at most.

At scale: texts cross one exchange and stay in the JVM, where sorting a bucket can spill; Python sees only
the buckets' sizes. Rows that are alike in all columns share a hash: where they are more than a bucket
holds, each is dealt by its own row number, so no bucket grows with the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, sent_whole

BUCKET_BYTES = 16 << 20
#: Buckets whose counts are added up in one window.
RUN = 1024


def scattered(df: DataFrame, seed: int, bucket_bytes: int, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(``df`` with _gl_bucket and the keys that order a bucket's rows: _gl_key, _gl_tie; number of rows; of buckets)."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    n_buckets = max(1, -(-total // bucket_bytes))
    hashed = [f.name for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    keyed = df.select(
        *df.columns, F.xxhash64(F.lit(seed), *hashed).alias("_gl_key"), F.xxhash64(F.lit(seed + 1), *hashed).alias("_gl_tie"),
        F.monotonically_increasing_id().alias("_gl_row"),
    )
    # keys with more rows than a bucket has on average: no more of them than buckets
    hot = keyed.groupBy("_gl_key").count().where(F.col("count") * n_buckets > n) if n_buckets > 1 else None
    if hot is not None:
        hot = checkpointed(hot.select("_gl_key", F.lit(True).alias("_gl_hot")))
        keyed = keyed.join(sent_whole(hot), "_gl_key", "left").withColumn("_gl_row", F.when(F.col("_gl_hot"), F.col("_gl_row")))
    else:
        keyed = keyed.withColumn("_gl_row", F.lit(None).cast("long"))
    bucket = F.pmod(F.xxhash64("_gl_key", "_gl_row"), F.lit(n_buckets))
    return keyed.select(*df.columns, bucket.alias("_gl_bucket"), "_gl_key", "_gl_tie"), n, n_buckets


def permutations(buckets: DataFrame, seed: int) -> DataFrame:
    """(_gl_bucket, _gl_start, _gl_order) of (_gl_bucket, count): where the bucket begins, and the place of each of
    its rows, by Fisher-Yates."""
    buckets = checkpointed(buckets.withColumn("run", F.floor(F.col("_gl_bucket") / RUN)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = buckets.groupBy("run").agg(F.sum("count").alias("_n"))  # a row for every thousand buckets
    runs = runs.select("run", F.coalesce(F.sum("_n").over(before(Window.orderBy("run"))), F.lit(0)).alias("_begin"))
    inside = F.coalesce(F.sum("count").over(before(Window.partitionBy("run").orderBy("_gl_bucket"))), F.lit(0))
    starts = buckets.withColumn("_in", inside).join(runs, "run").select("_gl_bucket", (F.col("_begin") + F.col("_in")).alias("_gl_start"), "count")

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (bucket, n) in enumerate(zip(b.column("_gl_bucket").to_pylist(), b.column("count").to_pylist())):
                order = np.arange(n, dtype=np.int32)
                np.random.default_rng([seed, bucket]).shuffle(order)
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one.column("_gl_bucket"), one.column("_gl_start"), pa.array([order])], ["_gl_bucket", "_gl_start", "_gl_order"])

    return starts.mapInArrow(fisher_yates, "_gl_bucket long, _gl_start long, _gl_order array<int>")


def shard_documents(df: DataFrame, n_shards: int = 8, seed: int = 20_240_601, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to n_shards-1) and a gapless ``slot``.

    Input columns named shard or slot, in any case, are replaced. Null texts and ids are ordinary values; an
    empty table gives an empty result. Rows alike in all columns are interchangeable, and each gets a
    slot of its own. Rows of equal hashes are dealt by their place in the input, which a lost executor's
    rerun must find again: give it a table that is read from files or checkpointed.
    """
    df = df.select(*(c for c in df.columns if c.lower() not in ("shard", "slot")))
    tagged, n, _ = scattered(df, seed, bucket_bytes, text_col)
    places = permutations(tagged.groupBy("_gl_bucket").count(), seed)
    rank = F.row_number().over(Window.partitionBy("_gl_bucket").orderBy("_gl_key", "_gl_tie"))
    placed = tagged.withColumn("_gl_rank", rank).join(places, "_gl_bucket")
    at = F.col("_gl_start") + F.get("_gl_order", F.col("_gl_rank") - 1)
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return (
        placed.select(*df.columns, at.alias("_gl_at"))
        .withColumn("shard", F.expr(f"int((_gl_at * {n_shards}) div {max(n, 1)})"))
        .select(*df.columns, "shard", (F.col("_gl_at") - first).alias("slot"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each file holds whole buckets, its rows in slot order. Reads back with ``shard`` as a column."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op1_sharding(docs: DataFrame) -> DataFrame:
    """Whole records are sharded, then reported: a null text has size 1 and the CRC of an empty one."""
    text = F.coalesce("text", F.lit(""))
    return shard_documents(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
