"""Micro-batches: staged rows are promoted into a master table; events are windowed and sessionised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import Policy, last_wins, overwrite, upsert
from ..operators.specs import TableSpec

#: Staged rows: which job has read what for which table; ``seq`` orders them.
STAGED = "job_id long, table_name string, payload string, seq long"
BUCKET = "_bucket"


def bucketed(df: DataFrame, spec: TableSpec, buckets: int) -> DataFrame:
    """``df`` with the partition of the master into which its key deals each row."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in spec.key)), F.lit(buckets)).cast("int"))


def seeded(df: DataFrame, spec: TableSpec, master: str, buckets: int) -> None:
    """Write a table as a master that :func:`promote_touched` can go on with."""
    bucketed(spec.migrated(df), spec, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(master)


def promoted(spark: SparkSession, spec: TableSpec, master: str) -> DataFrame | None:
    """The master as it is, or None before the first promotion."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(spec.schema.add(BUCKET, "integer")).parquet(master)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def promote_batch(batch: DataFrame, number: int, spec: TableSpec, master: str, order: Sequence[str], buckets: int) -> None:
    """Merge one micro-batch of staged payloads into the partitions of the master that it touches; no other file is written.

    Payloads that aren't JSON, or lack a part of the key, are counted and dropped. The new partitions are written aside before they
    replace the old ones, one after the other; if that breaks off, the batch comes again and gives the same rows. What it
    has done is a row in ``_promotions`` below the master: staged, broken, keys, partitions.
    """
    spark = batch.sparkSession
    mine = batch.where(F.col("table_name") == spec.name).persist()
    try:
        rows = spec.unpacked(mine).dropna(subset=list(spec.key))
        keys = bucketed(rows.select(*spec.key).distinct(), spec, buckets)
        touched = [r[0] for r in keys.select(BUCKET).distinct().collect()]  # as many as there are partitions
        staged, whole, distinct = mine.count(), rows.count(), keys.count()
        if touched:
            old = promoted(spark, spec, master)
            old = None if old is None else old.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            own = rows.select(*dict.fromkeys([*spec.written(mine), *order]))
            aside = f"{master}/_next/{number}"
            bucketed(spec.merged(old, own, order=order), spec, buckets).repartition(BUCKET).write.mode("overwrite").parquet(aside)
            spark.read.schema(spec.schema.add(BUCKET, "integer")).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(master)
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{master}/_next")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        log = spark.createDataFrame([(number, staged, staged - whole, distinct, len(touched))], "batch long, staged long, broken long, keys long, partitions long")
        log.coalesce(1).write.mode("overwrite").json(f"{master}/_promotions/{number}")
    finally:
        mine.unpersist()


def promote_touched(
    spark: SparkSession, spec: TableSpec, staging: str, master: str, checkpoint: str, order: Sequence[str] = ("seq",), buckets: int = 64, files_per_batch: int | None = None, every: str | None = None
) -> None:
    """Drain the staged files (``STAGED``) into the master of a specification, the oldest first, ``files_per_batch`` at a time, and stop;
    with ``every`` look for new ones at that interval until the query is stopped. See :func:`promote_batch`."""
    reader = spark.readStream.schema(STAGED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    write = reader.parquet(staging).writeStream.foreachBatch(lambda batch, number: promote_batch(batch, number, spec, master, order, buckets))
    write.option("checkpointLocation", checkpoint).trigger(**trigger).start().awaitTermination()


def promotions(spark: SparkSession, master: str) -> DataFrame:
    """What each batch has done."""
    return spark.read.schema("batch long, staged long, broken long, keys long, partitions long").json(f"{master}/_promotions/*")


def promote(spark: SparkSession, staging: str, master: str, checkpoint: str, schema: str, pk: Sequence[str], order: Sequence[str], policy: Policy = overwrite, every: str | None = None) -> None:
    """Drain the staged files into ``master`` and stop, or with ``every`` look for new ones at that interval until the
    query is stopped. A batch that is repeated after a failure changes nothing: it reads the newest version before
    its own, writes its own and only then points the table to it."""
    reader = spark.readStream.schema(schema).parquet(staging)

    def merge(batch: DataFrame, number: int) -> None:
        rows = last_wins(batch, pk, order)
        old = current(spark, master, number)
        new = rows if old is None else upsert(old, rows, pk, policy)
        new.write.mode("overwrite").parquet(f"{master}/v{number}")
        spark.range(1).select(F.lit(number).alias("version")).write.mode("append").json(f"{master}/versions")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    reader.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start().awaitTermination()


def current(spark: SparkSession, master: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table, or the newest before a number; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        version = spark.read.schema("version long").json(f"{master}/versions").where(F.lit(True) if before is None else F.col("version") < before).agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return None if version is None else spark.read.parquet(f"{master}/v{version}")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; in a stream, rows later than ``late`` are dropped by the watermark."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
