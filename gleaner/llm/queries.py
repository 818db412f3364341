"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytepairs, conversations, decontam, licenses, linededup, lm, negatives, quality, sentencepieces, sharding, simhash, tokencount, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def on(f: Callable[..., DataFrame], *names: str) -> Query:
        return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))

    return {
        "op1_sharding": on(sharding.op1_sharding, "documents"),
        "op2_lm_scoring": on(lm.op2_lm_scoring, "documents"),
        "op3_decontamination": on(decontam.op3_decontamination, "documents", "benchmark"),
        "op4_quality_rules": on(quality.op4_quality, "documents"),
        "op5_sentencepiece": on(sentencepieces.op5_sentencepiece, "documents"),
        "op6_toxicity": on(toxicity.op6_toxicity, "documents", "labels"),
        "op7_line_dedup": on(linededup.op7_line_dedup, "documents"),
        "op8_simhash": on(simhash.op8_simhash, "documents"),
        "op9_token_counts": on(tokencount.op9_token_counts, "documents"),
        "op10_license_scan": on(licenses.op10_license_scan, "documents"),
        "op11_hard_negatives": on(negatives.op11_hard_negatives, "embeddings"),
        "op12_conversation_repair": on(conversations.op12_conversation_repair, "conversations"),
        "op13_byte_bpe": on(bytepairs.op13_byte_bpe, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.SQL, "op7_line_dedup": linededup.SQL, "op11_hard_negatives": negatives.SQL}
