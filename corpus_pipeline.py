"""Five stages from raw documents to token ids: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage works on what the one before has kept, is written as Parquet and read again. All but the
last return the columns of ``documents``. Null texts pass every stage (they hold nothing to reject);
rows with a null doc_id are never taken for a copy or a contaminated document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, linededup, sentencepieces, simhash, toxicity
from gleaner.llm.common import shared_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the threshold; null and empty texts score as texts without tokens."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their hosts' boilerplate lines; a null source is a host of its own."""
    # the stage's own columns go by; whatever the input has keeps its name and place
    own = [c for c in ("doc_id", "source", "text", "n_chars") if c in docs.columns]
    held = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(*held).alias("_gl_held")) if held else docs
    out = linededup.drop_boilerplate(packed).drop("n_dropped_lines")
    out = out.select(*(F.col(f"_gl_held.{c}") if c in held else F.col(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group; null and wordless texts and rows with a null id stay."""
    return simhash.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap with no benchmark item; with an empty benchmark, all."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row: token ids and whether they decode to the text; a null text has none."""
    coded = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"), out_col="_gl_pieces")
    ids = F.col("_gl_pieces.ids")
    return coded.select("doc_id", "lang", "source", ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"), F.col("_gl_pieces.exact").alias("round_trip"))


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", leaks), ("encoding", tokens)]

#: The fitted field, the fingerprints and the pieces have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written below the shared checkpoint folder and read again."""
    at, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
