"""Registered queries that run as streams over staged files; the SQL has the rows of the same work in one go."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import promote as P
from ..streaming import sightings as S
from ..streaming.folders import scratch
from .catalogue import query
from .specified import COLLEGES

#: Seconds of a sweep, and partitions of the state.
WIDTH, PARTITIONS = 6 * 3600, 24
SEEN = """SELECT user_id AS id, ts AS seen_at, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('s', CAST(event_id % 7 AS STRING), substr('longer', 1, CAST(event_id % 6 AS INT))) END AS slug,
 concat('/', event_type) AS url, event_id % 3 = 0 AS home, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS tab, concat('2024-', CAST(10 + event_id % 90 AS STRING)) AS lastmod FROM {events} WHERE user_id % 10 <> 9 OR value < 40"""


def states(t):
    """The states of users from two starts of a stream: the earlier half of the files, then the rest."""
    seen, at = t.spark.sql(SEEN, events=t.read("events")), scratch(t.spark, "sightings")
    half = seen.agg(F.timestamp_seconds((F.unix_timestamp(F.min("seen_at")) + F.unix_timestamp(F.max("seen_at"))) / 2).alias("half"))
    early = seen.join(F.broadcast(half), F.col("seen_at") < F.col("half"), "left_semi")
    late = seen.join(F.broadcast(half), F.col("seen_at") < F.col("half"), "left_anti")
    for part in (early, late):
        part.write.mode("append").parquet(f"{at}/staged")
        stream = t.spark.readStream.schema(S.SIGHTING).parquet(f"{at}/staged")
        S.started(S.grown(stream, WIDTH), f"{at}/out", f"{at}/checkpoint", PARTITIONS).awaitTermination()
    return t.spark.read.parquet(f"{at}/out")


SWEPT = f"s AS (SELECT *, CAST(floor(epoch(seen_at) / {WIDTH}) AS BIGINT) AS sweep FROM ({SEEN.format(events='events')})), u AS (SELECT max(seen_at) AS until FROM s)"
AT = f"make_timestamp(CAST(({{}}) * {WIDTH} * 1000000 AS BIGINT))"


@query("P3_stream_states", f"""WITH {SWEPT}, h AS (SELECT id, slug, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(slug), slug, url) AS r FROM s WHERE home AND slug <> '') WHERE r = 1)
 SELECT s.id, coalesce(any_value(h.slug), '') AS slug, coalesce(any_value(h.url), '') AS url, max(lastmod) AS lastmod, coalesce(array_to_string(list_sort(list_distinct(list(tab))), ','), '') AS tabs, count(DISTINCT nullif(s.slug, '')) AS alias_count,
 {AT.format('min(sweep)')} AS first_seen, {AT.format('max(sweep)')} AS last_seen, {AT.format('max(sweep) + 2')} > any_value(until) AS active FROM s CROSS JOIN u LEFT JOIN h ON h.id = s.id GROUP BY s.id""")
def stream_states(t):
    """What state holds of each user after all sightings."""
    out = S.latest(states(t))
    return out.withColumn("tabs", F.array_join("tabs", ",")).select("id", "slug", "url", "lastmod", "tabs", "alias_count", "first_seen", "last_seen", "active")


@query("P4_stream_transitions", f"""WITH {SWEPT}, m AS (SELECT id, sweep, lag(sweep) OVER (PARTITION BY id ORDER BY sweep) AS was, lead(sweep) OVER (PARTITION BY id ORDER BY sweep) AS nxt FROM (SELECT DISTINCT id, sweep FROM s))
 SELECT id, CASE WHEN was IS NULL THEN 'new' ELSE 'returned' END AS event, {AT.format('sweep')} AS at FROM m WHERE was IS NULL OR sweep > was + 1 UNION ALL SELECT id, 'gone', {AT.format('sweep + 2')} FROM m CROSS JOIN u WHERE nxt > sweep + 1 OR nxt IS NULL AND {AT.format('sweep + 2')} <= until""")
def stream_transitions(t):
    """When users came, went for a whole sweep at least, and came back."""
    return S.transitions(states(t))


@query("P4_all_transitions", f"""WITH {SWEPT}, m AS (SELECT id, sweep, lag(sweep) OVER (PARTITION BY id ORDER BY sweep) AS was, lead(sweep) OVER (PARTITION BY id ORDER BY sweep) AS nxt FROM (SELECT DISTINCT id, sweep FROM s))
 SELECT id, CASE WHEN was IS NULL THEN 'new' ELSE 'returned' END AS event, {AT.format('sweep')} AS at FROM m WHERE was IS NULL OR sweep > was + 1 UNION ALL SELECT id, 'gone', {AT.format('sweep + 2')} FROM m CROSS JOIN u WHERE nxt > sweep + 1 OR nxt IS NULL AND {AT.format('sweep + 2')} <= until""")
def all_transitions(t):
    """The same in one go."""
    seen = t.spark.sql(SEEN, events=t.read("events"))
    until = seen.agg(F.max("seen_at")).first()[0]  # one value
    return S.all_transitions(seen, WIDTH, F.lit(until))


@query("P1_promoted_stream", """SELECT coalesce(c.college_id, d.college_id) AS college_id, CASE WHEN d.college_id IS NULL THEN c.name ELSE concat(d.name, '/', CAST(d.seq AS VARCHAR)) END AS name, CASE WHEN d.college_id IS NULL THEN c.city WHEN d.college_id % 7 = 0 THEN NULL ELSE d.city END AS city, c.rating
 FROM colleges c FULL JOIN (SELECT *, CASE WHEN college_id % 11 = 0 THEN 1 WHEN college_id % 4 = 0 THEN 3 ELSE 2 END AS seq FROM directory WHERE college_id % 3 <> 0 AND (college_id % 11 <> 0 OR college_id % 5 = 0)) d ON c.college_id = d.college_id""")
def promoted_stream(t):
    """Three staged files, one a batch, over the colleges: broken payloads are dropped, the last of a key's rows stays."""
    at = scratch(t.spark, "promotion")
    P.seeded(t.colleges.select("college_id", "name", "city", "rating"), COLLEGES, f"{at}/master", 16)
    rows = t.directory.where("college_id % 3 <> 0")
    fields = "to_json(named_struct('college_id', college_id, 'name', concat(name, '/', CAST(seq AS STRING)), 'city', CASE WHEN college_id % 7 = 0 THEN '' ELSE city END))"
    for seq, part in ((1, "college_id % 5 = 0"), (2, "true"), (3, "college_id % 4 = 0")):
        staged = rows.where(part).withColumn("seq", F.lit(seq).cast("long")).withColumn("payload", F.expr(fields))
        staged = staged.withColumn("payload", F.when((F.col("college_id") % 11 == 0) & (F.col("seq") > 1), F.concat(F.lit("{"), "payload")).otherwise(F.col("payload")))
        staged.select(F.lit(1).cast("long").alias("job_id"), F.lit("colleges").alias("table_name"), "payload", "seq").write.mode("append").parquet(f"{at}/staged")
    P.promote_touched(t.spark, COLLEGES, f"{at}/staged", f"{at}/master", f"{at}/checkpoint", buckets=16)
    return P.promoted(t.spark, COLLEGES, f"{at}/master").select("college_id", "name", F.nullif("city", F.lit("")).alias("city"), "rating")


REAPED = "SELECT user_id AS job_id, max(ts) AS heartbeat, max_by(event_type, struct(ts, event_id)) AS status FROM {events} GROUP BY user_id"


@query("P7_reaped_orphans", """WITH j AS (SELECT user_id AS job_id, max(ts) AS heartbeat, arg_max(event_type, {'ts': ts, 'id': event_id}) AS status FROM events GROUP BY user_id), now AS (SELECT max(ts) AS top FROM events)
 SELECT job_id, CASE WHEN status IN ('purchase', 'signup') THEN status WHEN heartbeat < top - INTERVAL 3 HOUR THEN 'interrupted' ELSE 'running' END AS status, CAST(floor(epoch(top) - epoch(heartbeat)) AS BIGINT) AS age FROM j CROSS JOIN now""")
def reaped(t):
    """Jobs that have not ended and whose last sign of life is over three hours old are interrupted."""
    jobs = t.spark.sql(REAPED, events=t.read("events"))
    now = t.read("events").agg(F.max("ts").alias("at"))  # one row
    age = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000 - F.unix_micros(F.col("heartbeat").cast("timestamp")) / 1_000_000)
    ended = F.col("status").isin("purchase", "signup")
    status = F.when(ended, F.col("status")).when(F.col("heartbeat") < F.col("at") - F.expr("INTERVAL 3 HOURS"), "interrupted").otherwise("running")
    return jobs.crossJoin(F.broadcast(now)).select("job_id", status.alias("status"), age.alias("age"))
