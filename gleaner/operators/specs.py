"""Table specifications: a table's key, columns, write policy, tracked columns and phases, and what follows from them.

A specification drives merging, staging, fingerprints and the addition of columns, so no writer states a policy twice. Readers
that go through :class:`Registry` bear tables and columns that aren't there: a missing table has no rows, a missing
column is NULL, and a report's figure about either is NULL rather than 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cdc, merge

#: What a batch does to a stored row: see :mod:`gleaner.operators.merge`. ``absent`` inserts new keys only.
POLICIES: dict[str, merge.Policy | None] = {"overwrite": merge.overwrite, "preserve": merge.preserve, "fill": merge.fill_empty, "absent": None}


@dataclass(frozen=True)
class Phase:
    """A writer of some of a table's columns, and the column in which it stamps the time of its visit."""

    columns: tuple[str, ...]
    stamp: str | None = None


@dataclass(frozen=True)
class TableSpec:
    """``columns`` maps names to types in their order; ``key`` names some of them. ``always`` are columns of provenance, which a
    batch refreshes whatever the policy. ``guard`` is SQL on the stored row; where it fails, a batch leaves the row alone.
    ``tracked`` says whether changes of the table are logged, ``untracked`` which further columns don't count."""

    name: str
    key: tuple[str, ...]
    columns: Mapping[str, str]
    policy: str = "overwrite"
    always: tuple[str, ...] = ()
    guard: str | None = None
    tracked: bool = True
    untracked: tuple[str, ...] = ()
    phases: Mapping[str, Phase] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"{self.name}: the policy {self.policy} is not known")
        phase_columns = [c for p in self.phases.values() for c in (*p.columns, *((p.stamp,) if p.stamp else ()))]
        for c in (*self.key, *self.always, *self.untracked, *phase_columns):
            if c not in self.columns:
                raise ValueError(f"{self.name} has no column {c}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.DataType.fromDDL(k)) for c, k in self.columns.items()])

    def migrated(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns that it lacks, as NULL; columns that the specification doesn't know stay, last."""
        have = {c.lower(): c for c in df.columns}
        own = [F.col(have[c.lower()]).alias(c) if c.lower() in have else F.lit(None).cast(k).alias(c) for c, k in self.columns.items()]
        known = {c.lower() for c in self.columns}
        return df.select(*own, *(c for c in df.columns if c.lower() not in known))

    def tracked_columns(self, phase: str | None = None) -> list[str]:
        """Columns whose change is a change of the row; for a phase those that it writes."""
        if not self.tracked:
            return []
        stamps = [p.stamp for p in self.phases.values() if p.stamp]
        skip = {*self.key, *cdc.UNTRACKED, *self.untracked, *self.always, *stamps}
        return sorted(c for c in (self.phases[phase].columns if phase else self.columns) if c not in skip and not c.endswith("_scraped_at"))

    def batch_of(self, rows: DataFrame, phase: str | None = None, order: Sequence[str] = ()) -> DataFrame:
        """The columns of ``rows`` that the writer owns, one row for each whole key: the last in ``order``."""
        own = set(self.phases[phase].columns) | {*self.key, *self.always} if phase else set(self.columns)
        last = merge.last_wins(rows, self.key, order or merge.sortable(rows, self.key))
        return last.select(*(F.col(c).cast(k).alias(c) for c, k in self.columns.items() if c in own and c in rows.columns))

    def merged(self, target: DataFrame | None, rows: DataFrame, phase: str | None = None, order: Sequence[str] = (), now: Column | None = None) -> DataFrame:
        """The table after a batch. Columns that the batch lacks, and those of other phases, stay as they are; ``now`` is
        written to the phase's stamp in each row that the batch meets."""
        stored = self.migrated(self.empty(rows.sparkSession) if target is None else target)
        batch = self.batch_of(rows, phase, order)
        stamp = self.phases[phase].stamp if phase else None
        if stamp and now is not None:
            batch = batch.withColumn(stamp, now.cast(self.columns[stamp]))
        policy = POLICIES[self.policy]
        if policy is None:
            return merge.insert_if_absent(stored, batch, self.key)
        fresh = {*self.always, *((stamp,) if stamp else ())}
        guard = None if self.guard is None else F.expr(qualified(self.guard, stored.columns))
        return merge.upsert(stored, batch, self.key, lambda old, new: policy(old, new), guard, {c: merge.overwrite for c in fresh})

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def staged(self, payloads: DataFrame, order: Sequence[str]) -> DataFrame:
        """One payload for each job and key of this table; see :func:`merge.staged`."""
        return merge.staged(payloads.where(F.col("table_name") == self.name), self.key, order)

    def unpacked(self, payloads: DataFrame, payload: str = "payload") -> DataFrame:
        """Rows of the table from JSON payloads with table_name; what isn't JSON, or another table's, gives no row. The
        other columns of ``payloads`` stay, but for those that the table has itself."""
        mine = payloads.where((F.col("table_name") == self.name) & F.try_parse_json(payload).isNotNull())
        row = F.from_json(F.col(payload), self.schema)
        rest = [c for c in payloads.columns if c not in (*self.columns, payload)]
        return mine.select(*rest, row.alias("_row")).select(*rest, *(F.col(f"_row.{c}") for c in self.columns))

    def written(self, payloads: DataFrame) -> list[str]:
        """Names of columns that any payload has: a writer that leaves a column out doesn't write it."""
        keys = F.explode(F.json_object_keys("payload"))
        mine = payloads.where((F.col("table_name") == self.name) & F.try_parse_json("payload").isNotNull())
        found = {r[0] for r in mine.select(keys.alias("k")).where(F.col("k").isin(*self.columns)).distinct().collect()}  # as many rows as the table has columns
        return [c for c in self.columns if c in found]

    def observed(self, before: DataFrame, after: DataFrame, now, phase: str | None = None) -> DataFrame:
        """What a write means for each row; a row that the phase has not stamped yet is new to it."""
        if phase and self.phases[phase].stamp:
            before = cdc.first_observation(before, self.phases[phase].stamp)
        return cdc.observed(before, after, self.key, self.tracked_columns(phase), now)


def qualified(sql: str, columns: Iterable[str]) -> str:
    """A condition on plain column names as one on the stored row, which merging calls ``t``; quoted texts stay as they are."""
    import re

    names = "|".join(sorted(map(re.escape, columns), key=len, reverse=True))
    return re.sub(rf"'[^']*'|(?<![\w.])({names})(?![\w.(])", lambda m: f"t.{m[1]}" if m[1] else m[0], sql)


class Registry:
    """Specifications by name, and where their tables are: ``read`` gives a table or raises an AnalysisException."""

    def __init__(self, specs: Iterable[TableSpec], read: Callable[[str], DataFrame]):
        self.specs = {s.name: s for s in specs}
        self.read = read

    def found(self, name: str) -> DataFrame | None:
        """The stored table as it is, or None if there is none. Other faults than a missing table are raised."""
        try:
            return self.read(name)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The table with all columns of its specification: missing ones are NULL, a missing table has no rows."""
        df = self.found(name)
        return self.specs[name].empty(spark) if df is None else self.specs[name].migrated(df)

    def write(self, spark: SparkSession, payloads: DataFrame, order: Sequence[str], now: Column | None = None) -> dict[str, DataFrame]:
        """The tables after one batch of JSON payloads for any of them, each by its own policy."""
        out = {}
        for name, spec in self.specs.items():
            rows = spec.unpacked(payloads).select(*spec.written(payloads), *order)
            out[name] = spec.merged(self.found(name), rows, None, order, now) if set(spec.key) <= set(rows.columns) else self.table(spark, name)
        return out

    def report(self, spark: SparkSession, figures: Mapping[str, tuple[str, str]]) -> DataFrame:
        """(figure, n) of aggregates {figure: (table, SQL)}; NULL where the table or a column of it is missing. Figures of
        one table take one scan."""
        by: dict[str, list[str]] = {}
        for name, (table, _) in figures.items():
            by.setdefault(table, []).append(name)
        out = []
        for table, names in by.items():
            df = self.found(table)
            fine = [x for x in names if df is not None and resolves(df, figures[x][1])]
            if fine:
                one = df.agg(*(F.expr(figures[x][1]).cast("long").alias(x) for x in fine))
                out.append(one.select(F.inline(F.array(*(F.struct(F.lit(x).alias("figure"), F.col(x).alias("n")) for x in fine)))))
            missing = [(x, None) for x in names if x not in fine]
            if missing:
                out.append(spark.createDataFrame(missing, "figure string, n long"))
        return reduce(DataFrame.unionAll, out)


def resolves(df: DataFrame, sql: str) -> bool:
    """Whether all columns of an aggregate are there; other faults of it are raised."""
    try:
        df.agg(F.expr(sql)).schema  # noqa: B018  analyses the plan
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            return False
        raise
    return True
