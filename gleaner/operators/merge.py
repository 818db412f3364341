"""Write policies as joins: what a batch does to a table, row by row and column by column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import missing

Policy = Callable[[Column, Column], Column]


def overwrite(old: Column, new: Column) -> Column:
    return new


def preserve(old: Column, new: Column) -> Column:
    """An absent incoming value keeps the stored one."""
    return F.when(missing(new), old).otherwise(new)


def fill_empty(old: Column, new: Column) -> Column:
    """A stored value wins; only blanks are filled."""
    return F.when(missing(old), new).otherwise(old)


def last_wins(batch: DataFrame, pk: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in ``order``. Rows without a whole key go."""
    w = Window.partitionBy(*pk).orderBy(*(F.col(c).desc() for c in order))
    return batch.dropna(subset=list(pk)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def sortable(df: DataFrame, pk: Sequence[str]) -> list[str]:
    """Columns beside the key by which rows can be sorted; the key, if there are none."""
    return [f.name for f in df.schema if f.name not in pk and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))] or list(pk)


def upsert(
    target: DataFrame, batch: DataFrame, pk: Sequence[str], policy: Policy = overwrite, guard: Column | None = None, own: Mapping[str, Policy] | None = None
) -> DataFrame:
    """Insert new keys; on a known key each column of the batch meets the policy, other columns stay.

    ``guard`` is a condition on the stored row (as alias ``t``); rows for which it fails are not touched. ``own`` has columns with
    a policy of their own. Batch rows without a whole key go; of a repeated key the greatest row by its other columns stays
    (:func:`last_wins` chooses by an order).
    """
    known = F.col("t._in").isNotNull()
    batch = last_wins(batch, pk, sortable(batch, pk))
    t, s = target.withColumn("_in", F.lit(1)).alias("t"), batch.withColumn("_in", F.lit(1)).alias("s")
    joined = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in pk], "full_outer")
    touched = F.col("s._in").isNotNull() & (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False)) | ~known)
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        if c in pk:
            out.append(F.coalesce(old, F.col(f"s.{c}")).alias(c))
        elif c in batch.columns:
            new = F.col(f"s.{c}")
            out.append(F.when(touched & known, (own or {}).get(c, policy)(old, new)).when(known, old).otherwise(new).alias(c))
        else:
            out.append(old.alias(c))
    return joined.select(*out)


def insert_if_absent(target: DataFrame, batch: DataFrame, pk: Sequence[str]) -> DataFrame:
    """New keys are added; of a repeated one the greatest row, and none without a whole key."""
    new = last_wins(batch, pk, sortable(batch, pk)).join(target.select(*pk), list(pk), "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def update_only(target: DataFrame, batch: DataFrame, pk: Sequence[str], policy: Policy = preserve) -> DataFrame:
    """Patch known rows; keys that the table lacks are not inserted."""
    return upsert(target, batch.join(target.select(*pk), list(pk), "left_semi"), pk, policy)


def staged(payloads: DataFrame, keys: Sequence[str], order: Sequence[str], literal_nulls: bool = False) -> DataFrame:
    """One payload for each (job_id, table_name, pk): the last. ``pk`` is the keys' text joined by ``|``; rows without a
    whole key go, or with ``literal_nulls`` an absent key is the text ``None``."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("None")) if literal_nulls else F.col(k).cast("string") for k in keys]
    keyed = payloads.withColumn("pk", F.concat(*(x for i, p in enumerate(parts) for x in ((F.lit("|"), p) if i else (p,)))))
    return last_wins(keyed, ["job_id", "table_name", "pk"], order)


def patched(target: DataFrame, batch: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Stored values of known rows are replaced only where the batch has one that isn't NULL."""
    return update_only(target, batch, pk, lambda old, new: F.coalesce(new, old))
