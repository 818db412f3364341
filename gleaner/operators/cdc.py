"""Change detection between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical, fingerprint


def kinds_of(df: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    return {c: df.schema[c].dataType for c in columns}


def with_fingerprint(df: DataFrame, columns: Sequence[str], name: str = "content_hash") -> DataFrame:
    return df.withColumn(name, fingerprint(kinds_of(df, columns)))


def field_changes(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(pk, field, old_value, new_value): a row for each tracked column whose canonical text differs."""
    text = lambda df, side: df.select(*pk, *(canonical(F.col(c), k).alias(f"{side}_{c}") for c, k in kinds_of(df, columns).items()))
    joined = text(before, "old").join(text(after, "new"), list(pk))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old_value"), F.col(f"new_{c}").alias("new_value")) for c in columns))
    return joined.select(*pk, F.inline(F.filter(pairs, lambda x: x["old_value"] != x["new_value"])))


def reconcile(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(pk, verdict, n_fields) of each key after a write: new, same, returned or changed.

    ``before`` has content_hash and inactive_since; a row without a hash counts as not seen before.
    """
    return judged(before, after, pk, columns).select(*pk, "verdict", "n_fields")


def judged(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """``after`` with ``_now`` and ``_was`` (its hash and the one before), ``verdict``, ``n_fields`` and the columns ``kept`` of ``before``
    as ``_kept_...``. Both sides meet once, by a shuffle: neither is gathered in the driver, however small it is thought to be."""
    texts = {f"_old_{c}": canonical(F.col(c), k) for c, k in kinds_of(before, columns).items()}
    old = before.select(
        *pk, F.col("content_hash").alias("_was"), F.col("inactive_since").isNotNull().alias("_gone"),
        *(F.col(c).alias(f"_kept_{c}") for c in kept), *(text.alias(c) for c, text in texts.items()),
    )
    joined = with_fingerprint(after, columns, "_now").join(old.hint("merge"), list(pk), "left")
    moved = sum((F.when(F.col(f"_old_{c}") != canonical(F.col(c), k), 1).otherwise(0) for c, k in kinds_of(after, columns).items()), F.lit(0))
    differs = (F.col("_was") != F.col("_now")) & (moved > 0)
    verdict = F.when(F.col("_was").isNull(), "new").when(F.col("_gone"), "returned").when(differs, "changed").otherwise("same")
    out = joined.withColumn("verdict", verdict).withColumn("n_fields", F.when(F.col("verdict") == "same", 0).otherwise(moved).cast("long"))
    return out.drop("_gone", *texts)


def mark_missing(table: DataFrame, sweep_start, seen: str = "last_seen", inactive: str = "inactive_since") -> DataFrame:
    """Rows not seen since the sweep began become inactive; nothing is deleted."""
    unseen = F.col(inactive).isNull() & (F.col(seen).isNull() | (F.col(seen) < F.lit(sweep_start)))
    return table.withColumn(inactive, F.when(unseen, F.lit(sweep_start)).otherwise(F.col(inactive)))


#: Columns that say when and by which job a row was read, not what it says.
UNTRACKED = ("content_hash", "first_seen", "last_seen", "last_changed", "inactive_since", "source_job_id", "scraped_at", "created_at", "updated_at", "raw_json")
CLIP = 400


def tracked_columns(df: DataFrame, pk: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    """Columns whose change is a change of the row, in the order of their names."""
    return sorted(c for c in df.columns if c not in (*pk, *UNTRACKED, *extra) and not c.endswith("_scraped_at"))


def first_observation(before: DataFrame, stamp: str) -> DataFrame:
    """A row that a phase has not stamped yet is new to it, whatever other phases wrote: its hash goes."""
    return before.withColumn("content_hash", F.when(F.col(stamp).isNotNull(), F.col("content_hash")))


def observed(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str], now) -> DataFrame:
    """``after`` with what a write means for each row: ``verdict``, ``n_fields``, ``resynced`` (another hash, but no
    column differs) and the freshness columns as they are written.

    ``before`` has content_hash, first_seen, last_changed and inactive_since. Keys that the write left out are not looked at.
    """
    at = F.lit(now)
    out = judged(before, after, pk, columns, ["first_seen", "last_changed"]).where(" and ".join(f"`{k}` is not null" for k in pk))
    out = out.withColumnsRenamed({"_now": "content_hash", "_kept_first_seen": "_first", "_kept_last_changed": "_changed"})
    moved = F.col("_was").isNull() | ((F.col("_was") != F.col("content_hash")) & (F.col("n_fields") > 0))
    return out.select(
        *after.columns, "content_hash", "verdict", "n_fields",
        (F.col("_was").isNotNull() & (F.col("_was") != F.col("content_hash")) & (F.col("n_fields") == 0)).alias("resynced"),
        F.coalesce("_first", at).alias("first_seen"), at.alias("last_seen"), F.when(moved, at).otherwise(F.col("_changed")).alias("last_changed"),
        F.lit(None).cast(before.schema["inactive_since"].dataType).alias("inactive_since"),
    )


def clipped(text: Column) -> Column:
    """At most CLIP characters and an ellipsis; '' is absent."""
    return F.when(F.length(text) > CLIP, F.concat(F.left(text, F.lit(CLIP)), F.lit("…"))).otherwise(F.nullif(text, F.lit("")))


def change_log(before: DataFrame, after: DataFrame, pk: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(pk, change_type, field, old_value, new_value): one ``new`` or ``returned`` row with field ``*``, or a ``changed`` row
    for each field. A row that returns with other values is logged by its fields only; one that is the ``same`` isn't logged,
    whatever its columns say."""
    verdicts = reconcile(before, after, pk, columns)
    none = F.lit(None).cast("string")
    whole = verdicts.where((F.col("verdict") == "new") | ((F.col("verdict") == "returned") & (F.col("n_fields") == 0)))
    whole = whole.select(*pk, F.col("verdict").alias("change_type"), F.lit("*").alias("field"), none.alias("old_value"), none.alias("new_value"))
    moved = verdicts.where(F.col("verdict").isin("changed", "returned")).select(*pk)
    fields = field_changes(before, after, pk, columns).join(moved, list(pk), "left_semi")
    fields = fields.select(*pk, F.lit("changed").alias("change_type"), "field", clipped(F.col("old_value")).alias("old_value"), clipped(F.col("new_value")).alias("new_value"))
    return whole.unionByName(fields)


def gone_rows(table: DataFrame, pk: Sequence[str], sweep_start, scope=None, seen: str = "last_seen", inactive: str = "inactive_since") -> DataFrame:
    """(pk, change_type, field): a ``gone`` row for each key in scope that a sweep did not meet and that was not gone before."""
    unseen = F.col(inactive).isNull() & (F.col(seen).isNull() | (F.col(seen) < F.lit(sweep_start)))
    return table.where(unseen if scope is None else unseen & scope).select(*pk, F.lit("gone").alias("change_type"), F.lit("*").alias("field"))


def finalise_guard(table: DataFrame, sweep_start, least: float = 0.9, seen: str = "last_seen", inactive: str = "inactive_since") -> DataFrame:
    """One row: how much of a table a sweep has met again, what finalising would flag, and whether it is refused."""
    out = table.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(seen) >= F.lit(sweep_start)).alias("seen"), F.count_if(F.col(inactive).isNotNull()).alias("already"))
    share = F.coalesce(F.col("seen") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return out.select("total", "seen", "already", F.round(share, 4).alias("share"), (F.col("total") - F.col("seen") - F.col("already")).alias("would_flag"), (share < least).alias("refused"))


def backfilled_hashes(table: DataFrame, columns: Sequence[str], seeds: Sequence[str]) -> DataFrame:
    """Rows without a hash get one, and their first times from the first of ``seeds`` that they hold."""
    new, seed = F.col("content_hash").isNull(), F.coalesce(*seeds)
    out = with_fingerprint(table, columns, "_now")
    for c in ("first_seen", "last_seen", "last_changed"):
        out = out.withColumn(c, F.when(new, F.coalesce(c, seed)).otherwise(F.col(c)))
    return out.withColumn("content_hash", F.coalesce("content_hash", "_now")).drop("_now")


def rehashed(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """New hashes of all rows and no other time; ``moved``: the stored one was another."""
    out = with_fingerprint(table, columns, "_now").withColumn("moved", F.coalesce(F.col("content_hash") != F.col("_now"), F.lit(True)))
    return out.withColumn("content_hash", F.col("_now")).drop("_now")


def stamped(table: DataFrame, now) -> DataFrame:
    """Rows without first or last times are stamped; others keep theirs."""
    return table.withColumn("first_seen", F.coalesce("first_seen", F.lit(now))).withColumn("last_changed", F.coalesce("last_changed", F.lit(now)))


def freshness(table: DataFrame, name: str, now, stale_before, changed_since) -> DataFrame:
    """One row on a table: total, never_seen, stale, inactive, hashed, changed_recently."""
    recent = (F.col("last_changed") >= F.lit(changed_since)) & (F.col("last_changed") > F.coalesce("first_seen", F.lit(0).cast("timestamp")))
    return table.agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("last_seen").isNull()).alias("never_seen"), F.count_if(F.col("last_seen") < F.lit(stale_before)).alias("stale"),
        F.count_if(F.col("inactive_since").isNotNull()).alias("inactive"), F.count("content_hash").alias("hashed"), F.count_if(recent).alias("changed_recently"),
    )
