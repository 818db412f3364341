"""Registered queries of change detection: what a write means row by row, sweeps, freshness and the log."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cdc, merge
from .catalogue import n, query

NOW = datetime.datetime(2024, 6, 1)
AT = "TIMESTAMP '2024-06-01 00:00:00'"
TRACKED = ["name", "stream", "college_count"]
#: Courses as they were stored: some absent, gone, never hashed, hashed by an older rule, or not stamped by this phase.
STORED = """SELECT course_id, name, stream, college_count,
 CASE WHEN course_id % 9 = 0 THEN NULL WHEN course_id % 17 = 0 THEN 'older rule' ELSE {hash} END AS content_hash,
 CASE WHEN course_id % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS inactive_since,
 CASE WHEN course_id % 9 <> 0 THEN TIMESTAMP '2023-01-01 00:00:00' END AS first_seen, CASE WHEN course_id % 9 <> 0 THEN TIMESTAMP '2023-05-01 00:00:00' END AS last_changed,
 CASE WHEN course_id % 4 = 0 THEN TIMESTAMP '2024-05-20 00:00:00' WHEN course_id % 9 = 0 THEN NULL ELSE TIMESTAMP '2023-06-01 00:00:00' END AS last_seen,
 CASE WHEN course_id % 6 <> 0 THEN TIMESTAMP '2023-02-01 00:00:00' END AS detail_at FROM {courses} WHERE course_id % 10 <> 0"""
WRITTEN = """SELECT course_id, CASE WHEN course_id % 7 = 0 THEN concat(name, ' x') WHEN course_id % 77 = 3 THEN '' ELSE name END AS name, stream,
 CASE WHEN course_id % 13 = 0 THEN college_count + 1 ELSE college_count END AS college_count FROM {courses} WHERE course_id % 23 <> 5"""
SHA = "sha1(concat('college_count', chr(31), CAST(college_count AS STRING), chr(30), 'name', chr(31), trim(name), chr(30), 'stream', chr(31), trim(stream), chr(30)))"
SQL_BEFORE = "b AS (" + STORED.format(hash=SHA, courses="courses") + ")"
SQL_AFTER = f"a AS (SELECT *, {SHA} AS h FROM (" + WRITTEN.format(courses="courses") + "))"
#: Columns that differ, the hash and the verdict of every written row.
SQL_BOTH = f"""{SQL_BEFORE}, {SQL_AFTER}, j AS (SELECT a.*, b.content_hash AS was, b.inactive_since AS gone, b.first_seen AS f, b.last_changed AS lc, b.name AS old_name, b.college_count AS old_count, b.course_id AS known, b.detail_at,
 CASE WHEN b.course_id IS NULL OR b.content_hash IS NULL THEN 0 ELSE 1 END AS seen_before, CASE WHEN a.name <> b.name THEN 1 ELSE 0 END + CASE WHEN a.college_count <> b.college_count THEN 1 ELSE 0 END AS d FROM a LEFT JOIN b ON a.course_id = b.course_id),
 v AS (SELECT *, CASE WHEN was IS NULL THEN 'new' WHEN gone IS NOT NULL THEN 'returned' WHEN was <> h AND d > 0 THEN 'changed' ELSE 'same' END AS verdict FROM j)"""


def before(t):
    df = t.spark.sql(STORED.format(hash="'fresh'", courses="{courses}"), courses=t.courses)
    return cdc.with_fingerprint(df, TRACKED, "_h").withColumn("content_hash", F.when(F.col("content_hash") == "fresh", F.col("_h")).otherwise(F.col("content_hash"))).drop("_h")


def after(t):
    return t.spark.sql(WRITTEN, courses=t.courses)


@query("L1_tracked_columns", "SELECT * FROM (VALUES ('college_count'), ('detail_at'), ('name'), ('stream')) AS x(field) WHERE (SELECT count(*) FROM courses) >= 0")
def l1(t):
    b = before(t)
    names = cdc.tracked_columns(b, ["course_id"])
    return b.limit(1).select(F.explode(F.array(*map(F.lit, names))).alias("field"))


@query("L4_observe", f"WITH {SQL_BOTH} SELECT course_id, verdict, CAST(CASE WHEN known IS NULL THEN 0 ELSE d END AS BIGINT) AS n_fields, (was IS NOT NULL AND was <> h AND d = 0) AS resynced, coalesce(f, {AT}) AS first_seen, CASE WHEN was IS NULL OR (was <> h AND d > 0) THEN {AT} ELSE lc END AS last_changed, {AT} AS last_seen, h AS content_hash FROM v")
def l4(t):
    return cdc.observed(before(t), after(t), ["course_id"], TRACKED, NOW).select("course_id", "verdict", "n_fields", "resynced", "first_seen", "last_changed", "last_seen", "content_hash")


@query("L6_change_log", f"""WITH {SQL_BOTH} SELECT course_id, verdict AS change_type, '*' AS field, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM v WHERE verdict = 'new' OR (verdict = 'returned' AND d = 0)
 UNION ALL SELECT course_id, 'changed', 'name', nullif(old_name, ''), nullif(name, '') FROM v WHERE seen_before = 1 AND name <> old_name UNION ALL SELECT course_id, 'changed', 'college_count', CAST(old_count AS VARCHAR), CAST(college_count AS VARCHAR) FROM v WHERE seen_before = 1 AND college_count <> old_count""")
def l6_log(t):
    return cdc.change_log(before(t), after(t), ["course_id"], TRACKED)


@query("L6_counters", f"WITH {SQL_BOTH} SELECT verdict, count(*) AS n, count(*) FILTER (WHERE was IS NOT NULL AND was <> h AND d = 0) AS resynced FROM v GROUP BY verdict")
def l6_counters(t):
    return cdc.observed(before(t), after(t), ["course_id"], TRACKED, NOW).groupBy("verdict").agg(n(), F.count_if("resynced").alias("resynced"))


PATCH = "SELECT course_id, CASE WHEN course_id % 3 = 0 THEN '' ELSE concat(name, ' y') END AS name, CAST(NULL AS STRING) AS stream FROM {courses} WHERE course_id % 2 = 0"


@query("L5_read_back", f"WITH {SQL_BEFORE}, p AS ({PATCH.format(courses='courses')}) SELECT b.course_id, 'name' AS field, b.name AS old_value, p.name AS new_value FROM b JOIN p ON p.course_id = b.course_id WHERE p.name <> '' AND p.name <> b.name")
def l5(t):
    """Changes are what a second reading shows, whatever the policy made of the batch."""
    b = before(t).select("course_id", "name", "stream")
    written = merge.upsert(b, t.spark.sql(PATCH, courses=t.courses), ["course_id"], merge.preserve)
    return cdc.field_changes(b, written, ["course_id"], ["name", "stream"])


@query("L8_first_observation", f"WITH {SQL_BOTH} SELECT CASE WHEN was IS NULL OR detail_at IS NULL THEN 'new' WHEN gone IS NOT NULL THEN 'returned' WHEN was <> h AND d > 0 THEN 'changed' ELSE 'same' END AS verdict, count(*) AS n FROM j GROUP BY 1")
def l8(t):
    """A phase's first write to a row is one ``new``, not many changes."""
    return cdc.reconcile(cdc.first_observation(before(t), "detail_at"), after(t), ["course_id"], TRACKED).groupBy("verdict").agg(n())


SWEEP = datetime.datetime(2024, 5, 1)
SWEEP_SQL = "TIMESTAMP '2024-05-01 00:00:00'"


@query("L9_gone_rows", f"WITH {SQL_BEFORE} SELECT course_id, 'gone' AS change_type, '*' AS field FROM b WHERE inactive_since IS NULL AND (last_seen IS NULL OR last_seen < {SWEEP_SQL}) AND stream = 'Brand#1'")
def l9_gone(t):
    """Only the swept partition can lose rows."""
    return cdc.gone_rows(before(t), ["course_id"], SWEEP, F.col("stream") == "Brand#1")


@query("L10_finalise_guard", f"WITH {SQL_BEFORE} SELECT total, seen, already, round(seen / total, 4) AS share, total - seen - already AS would_flag, seen / total < 0.9 AS refused FROM (SELECT count(*) AS total, count(*) FILTER (WHERE last_seen >= {SWEEP_SQL}) AS seen, count(*) FILTER (WHERE inactive_since IS NOT NULL) AS already FROM b)")
def l10(t):
    return cdc.finalise_guard(before(t), SWEEP)


@query("L11_backfilled_hashes", f"WITH {SQL_BEFORE} SELECT course_id, coalesce(content_hash, {SHA}) AS content_hash, CASE WHEN content_hash IS NULL THEN coalesce(first_seen, detail_at, {AT}) ELSE first_seen END AS first_seen FROM b")
def l11(t):
    b = before(t).withColumn("created_at", F.lit(NOW))
    return cdc.backfilled_hashes(b, TRACKED, ["detail_at", "created_at"]).select("course_id", "content_hash", "first_seen")


@query("L12_rehash", f"WITH {SQL_BEFORE} SELECT coalesce(content_hash <> {SHA}, true) AS moved, count(*) AS n FROM b GROUP BY 1")
def l12(t):
    return cdc.rehashed(before(t), TRACKED).groupBy("moved").agg(n())


@query("L13_stamped", f"WITH {SQL_BEFORE} SELECT course_id, coalesce(first_seen, {AT}) AS first_seen, coalesce(last_changed, {AT}) AS last_changed FROM b")
def l13(t):
    return cdc.stamped(before(t), NOW).select("course_id", "first_seen", "last_changed")


#: A log of changes, made from orders.
LOG = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'changed' WHEN 'O' THEN 'new' ELSE 'gone' END AS change_type, substring(o_orderpriority, 3, 20) AS table_name, CASE WHEN o_orderstatus = 'F' THEN concat('f', CAST(o_custkey % 5 AS STRING)) ELSE '*' END AS field, o_custkey AS row_key, o_orderdate AS changed_at FROM {orders}"
LOG_SQL = f"changes AS ({LOG.format(orders='orders')})"


def log(t):
    return t.spark.sql(LOG, orders=t.read("orders"))


@query("L14_recent_changes", f"WITH {LOG_SQL} SELECT id, change_type, row_key, changed_at FROM changes WHERE table_name = 'HIGH' AND change_type = 'changed' ORDER BY changed_at DESC, id DESC LIMIT 100")
def l14(t):
    return log(t).where("table_name = 'HIGH' and change_type = 'changed'").orderBy(F.desc("changed_at"), F.desc("id")).limit(100).select("id", "change_type", "row_key", "changed_at")


@query("F31_change_summary", f"WITH {LOG_SQL}, u AS (SELECT 'type' AS kind, change_type AS value FROM changes UNION ALL SELECT 'table', table_name FROM changes UNION ALL SELECT 'field', field FROM changes WHERE field <> '*') SELECT kind, value, n FROM (SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS pos FROM u GROUP BY kind, value) WHERE pos <= 15")
def f31_changes(t):
    """Changes by type, table and field, the 15 most common of each."""
    one = lambda name, c: log(t).where(F.col(c) != "*").select(F.lit(name).alias("kind"), F.col(c).alias("value"))
    counts = one("type", "change_type").union(one("table", "table_name")).union(one("field", "field")).groupBy("kind", "value").agg(n())
    return counts.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))).where("pos <= 15").drop("pos")


@query("L15_freshness_report", f"WITH {SQL_BEFORE} SELECT 'courses' AS table_name, count(*) AS total, count(*) FILTER (WHERE last_seen IS NULL) AS never_seen, count(*) FILTER (WHERE last_seen < TIMESTAMP '2024-01-01 00:00:00') AS stale, count(*) FILTER (WHERE inactive_since IS NOT NULL) AS inactive, count(content_hash) AS hashed, count(*) FILTER (WHERE last_changed >= TIMESTAMP '2023-03-01 00:00:00' AND last_changed > coalesce(first_seen, TIMESTAMP '1970-01-01 00:00:00')) AS changed_recently FROM b")
def l15_report(t):
    return cdc.freshness(before(t), "courses", NOW, datetime.datetime(2024, 1, 1), datetime.datetime(2023, 3, 1))


@query("L16_change_activity", f"WITH {LOG_SQL} SELECT table_name, strftime(changed_at, '%Y-%m') AS month, count(*) AS n, count(DISTINCT row_key) AS row_keys FROM changes GROUP BY 1, 2")
def l16(t):
    return log(t).groupBy("table_name", F.date_format("changed_at", "yyyy-MM").alias("month")).agg(n(), F.countDistinct("row_key").alias("row_keys"))


#: A sweep for each partition of the directory by state; state 3 has been retired.
SWEEPS = "SELECT CAST(r_regionkey AS BIGINT) AS state_id, r_name AS sweep, r_regionkey = 3 AS retired FROM {region} WHERE r_regionkey <> 4"


@query("L17_sweep_plan", f"""WITH s AS ({SWEEPS.format(region='region')}), q AS (SELECT d.state_id, count(*) AS total, count(*) FILTER (WHERE p.updated_at IS NULL OR p.updated_at < TIMESTAMP '1998-01-01 00:00:00') AS stale FROM directory d LEFT JOIN progress p ON p.college_id = d.college_id GROUP BY d.state_id)
 SELECT q.state_id, s.sweep, total, stale, CASE WHEN s.state_id IS NULL THEN 'orphan' WHEN s.retired THEN 'retired' WHEN stale > 0 THEN 'sweep' ELSE 'fresh' END AS plan FROM q LEFT JOIN s ON s.state_id = q.state_id""")
def l17_sweeps(t):
    """Stale rows of each partition, and what to do about them: a retired sweep isn't run, a partition without one is an orphan."""
    sweeps = F.broadcast(t.spark.sql(SWEEPS, region=t.read("region")))  # a row for each partition of the inventory
    stale = F.col("updated_at").isNull() | (F.col("updated_at") < F.lit(datetime.datetime(1998, 1, 1)))
    q = t.directory.join(t.progress, "college_id", "left").groupBy("state_id").agg(n("total"), F.count_if(stale).alias("stale"))
    plan = F.when(F.col("sweep").isNull(), "orphan").when(F.col("retired"), "retired").when(F.col("stale") > 0, "sweep").otherwise("fresh")
    return q.join(sweeps, "state_id", "left").select("state_id", "sweep", "total", "stale", plan.alias("plan"))


@query("L18_reset_sweep", f"WITH s AS ({SWEEPS.format(region='region')}) SELECT p.college_id, p.status FROM progress p JOIN directory d ON d.college_id = p.college_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.state_id = d.state_id AND NOT s.retired AND s.sweep LIKE 'A%')")
def l18(t):
    """Progress rows of the sweeps to be repeated go, data rows stay; a retired sweep is not repeated."""
    again = F.broadcast(t.spark.sql(SWEEPS, region=t.read("region")).where("not retired and sweep like 'A%'"))
    rows = t.progress.join(t.directory.select("college_id", "state_id"), "college_id")
    return rows.join(again, "state_id", "left_anti").select("college_id", "status")


@query("L19_size_snapshots", "SELECT day, n, total FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS BIGINT) AS total FROM logs GROUP BY 1) ORDER BY day DESC LIMIT 14")
def l19(t):
    """The table's size after each day, newest first."""
    days = t.logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(n())  # one row a day
    return days.withColumn("total", F.sum("n").over(Window.orderBy("day"))).orderBy(F.desc("day")).limit(14)
