"""Helpers that several training-data operators share."""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper limit of text that one step of Python work holds as separate words.
SLICE_BYTES = 1 << 20
NOT_DIGITS = re.compile(r"\D")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset: a folder of the warehouse, which a cluster shares, too;
    in local mode, where driver and tasks are one process, a temporary folder. A cluster without either is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="spark-")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse.rstrip("/") + "/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; the shuffle files that it was made from go at once."""
    ensure_checkpoint_dir(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()


def in_small_batches(df: DataFrame, batch_bytes: int = 2 << 20) -> DataFrame:
    """``df``, with the session's Arrow batches held to some megabytes: 10,000 long texts are no unit of work."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(NOT_DIGITS.sub("", conf.get(name))) <= batch_bytes:
        conf.set(name, str(batch_bytes))
    return df


def sent(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """A broadcast of ``thing``, and what gives it in a task. Its classes travel with it, as code does, so that workers
    need no copy of this library; a plain broadcast would only name them."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(shared.value)


def sent_whole(keys: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``keys`` marked for broadcast if it is counted to hold at most ``most_rows``; else the join shuffles.

    For materialised tables of one or two numbers a row, so that the bound is one of bytes, too.
    """
    return F.broadcast(keys) if keys.limit(most_rows + 1).count() <= most_rows else keys


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A lambda variable is bound once; a plain column would be copied into every place that names it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch of about ``limit`` text bytes; a longer text is a piece of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def u64(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as the signed longs that Spark has."""
    return pa.array(u64(values).view(np.int64))
