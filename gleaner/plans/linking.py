"""Registered queries of record linkage: colleges (left) against the directory (right)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import linkage, merge
from .catalogue import n, query

# Hosts of mail services, and of sites that cite others.
JUNK_MAIL = (
    "gmail.com", "yahoo.com", "yahoo.co.in", "hotmail.com", "outlook.com", "rediffmail.com", "live.com", "aol.com", "icloud.com",
    "protonmail.com", "googlemail.com", "ymail.com", "mail.com",
)
JUNK_SITES = (
    *JUNK_MAIL, "facebook.com", "wikipedia.org", "google.com", "youtube.com", "linkedin.com", "twitter.com", "x.com", "instagram.com",
    "blogspot.com", "wordpress.com", "wixsite.com",
)
#: Contact columns that the given tables lack, in SQL that both engines run.
LEFT = """SELECT college_id AS id, name, replace(city, '_', 'x') AS city, CASE WHEN college_id % 9 = 4 THEN 'https://www.facebook.com/x' ELSE website END AS website, phone,
 CASE WHEN college_id % 4 = 3 THEN '' WHEN college_id % 10 = 2 THEN 'office@gmail.com' ELSE concat('Office@Mail', CAST(college_id - college_id % 2 AS STRING), '.ac.in') END AS email,
 concat('S.', upper(substring(city, 1, 3)), '-', CAST(college_id % 20 AS STRING)) AS short_form, concat(name, ' ', city, CASE WHEN college_id % 3 = 1 THEN ' v' ELSE ' u' END, substring(name, length(name) - 2, 3)) AS full_name FROM {colleges}"""
RIGHT = """SELECT college_id AS id, name, replace(city, '_', 'x') AS city, website, phone,
 CASE WHEN college_id % 5 = 4 THEN NULL WHEN college_id % 10 = 7 THEN 'info@yahoo.com' ELSE concat('info@mail', CAST(college_id - college_id % 4 AS STRING), '.ac.in') END AS email,
 CASE WHEN college_id % 3 = 0 THEN '' ELSE concat('s', lower(substring(city, 1, 3)), CAST(college_id % 30 AS STRING)) END AS short_form, concat(name, ' ', city, ' u', substring(name, length(name) - 2, 3)) AS full_name FROM {directory}"""


def sides(t):
    def keyed(df):
        host = lambda c, junk: F.when(~X.domain(F.col(c)).isin(*junk), X.domain(F.col(c)))
        return df.select(
            "id", "name", "full_name", "city", host("website", JUNK_SITES).alias("website"), host("email", JUNK_MAIL).alias("email"), X.phone_key(F.col("phone")).alias("phone"),
            X.shortform_key(F.col("short_form")).alias("short_form"),
        )

    return keyed(t.spark.sql(LEFT, colleges=t.colleges)), keyed(t.spark.sql(RIGHT, directory=t.directory))


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


HOST = r"regexp_replace(regexp_extract(regexp_replace(regexp_extract(lower(trim({c})), '([^@]*)$', 1), '^[a-z]+://', ''), '^([^/?:]*)', 1), '^www\.', '')"


def host_sql(c: str, junk) -> str:
    h = HOST.format(c=c)
    return f"CASE WHEN contains({h}, '.') AND length({h}) > 4 AND {h} NOT IN {listed(junk)} THEN {h} END AS {c}"


def side_sql(name: str, source: str) -> str:
    digits = "regexp_replace(phone, '[^0-9]', '', 'g')"
    short = "regexp_replace(lower(short_form), '[^a-z0-9]', '', 'g')"
    return (
        f"{name} AS (SELECT id, name, full_name, city, {host_sql('website', JUNK_SITES)}, {host_sql('email', JUNK_MAIL)}, CASE WHEN length({digits}) >= 10 THEN right({digits}, 10) ELSE '' END AS phone,"
        f" CASE WHEN length({short}) >= 3 THEN {short} ELSE '' END AS short_form FROM ({source.format(colleges='colleges', directory='directory')}))"
    )


TOKENS = f"list_sort(list_distinct(list_filter(string_split_regex(lower({{x}}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {listed(X.STOP_WORDS)})))"


def tier_sql(tier: str, key: str) -> str:
    one = lambda side: f"(SELECT id, {key} AS k, count(*) OVER (PARTITION BY {key}) AS n FROM {side} WHERE coalesce({key}, '') <> '')"
    return f"SELECT l.id AS l_id, r.id AS r_id, '{tier}' AS tier, CAST(CASE WHEN r.n = 1 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score, 'yes' AS verdict, l.k AS value FROM {one('ls')} l JOIN {one('rs')} r ON l.k = r.k WHERE l.n <= 3 AND r.n <= 3"


SHORT_SQL = f"""SELECT l_id, r_id, 'short_form' AS tier, CAST(0.95 AS DOUBLE) AS score, 'yes' AS verdict, k AS value FROM (SELECT l.id AS l_id, r.id AS r_id, l.short_form AS k, row_number() OVER (PARTITION BY l.id ORDER BY r.id) AS pos
 FROM ls l JOIN rs r ON l.short_form = r.short_form WHERE l.short_form <> '' AND len(list_intersect({TOKENS.format(x='l.city')}, {TOKENS.format(x='r.city')})) > 0) WHERE pos <= 8"""


def best_sql(cap: int = 600, least: float = 0.45, sure: float = 0.85) -> str:
    """CTEs up to ``nm``: the best right row of each left row, by all pairs that share an opened word."""
    return f"""lt AS (SELECT id, {TOKENS.format(x='full_name')} AS tk FROM ls), rt AS (SELECT id, {TOKENS.format(x='full_name')} AS tk FROM rs), rx AS (SELECT id, tk, unnest(tk) AS token FROM rt),
 dfs AS (SELECT token, count(*) AS df FROM rx GROUP BY token),
 q AS (SELECT x.id, x.tk, x.token, row_number() OVER (PARTITION BY x.id ORDER BY coalesce(df, 0), x.token) AS b FROM (SELECT id, tk, unnest(tk) AS token FROM lt) x LEFT JOIN dfs ON dfs.token = x.token),
 cand AS (SELECT q.id AS l_id, rx.id AS r_id, min(b) AS b, any_value(q.tk) AS lk, any_value(rx.tk) AS rk FROM q JOIN rx ON q.token = rx.token WHERE b <= 3 GROUP BY q.id, rx.id),
 seen AS (SELECT l_id, b, count(*) AS m FROM cand GROUP BY l_id, b),
 scored AS (SELECT l_id, r_id, b, round(CAST(len(list_intersect(lk, rk)) AS DOUBLE) / (len(lk) + len(rk) - len(list_intersect(lk, rk))), 6) AS score FROM cand c WHERE coalesce((SELECT sum(m) FROM seen s WHERE s.l_id = c.l_id AND s.b < c.b), 0) <= {cap}),
 nm AS (SELECT l_id, r_id, 'name' AS tier, score, CASE WHEN score >= {sure} THEN 'yes' ELSE 'pending' END AS verdict, CAST(NULL AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, b, r_id) AS pos FROM scored) WHERE pos = 1 AND score >= {least})"""


SIDES = f"{side_sql('ls', LEFT)}, {side_sql('rs', RIGHT)}"
ALL = f"{SIDES}, {best_sql()}, pairs AS ({tier_sql('website', 'website')} UNION ALL {tier_sql('phone', 'phone')} UNION ALL {tier_sql('email', 'email')} UNION ALL {SHORT_SQL} UNION ALL SELECT * FROM nm)"
RANK = "list_position(['name', 'short_form', 'email', 'phone', 'website'], tier)"
MERGED = f"""merged AS (SELECT l_id, r_id, arg_max(tier, {RANK}) AS tier, max(score) AS score, CASE WHEN bool_or(verdict = 'yes') THEN 'yes' ELSE 'pending' END AS verdict,
 array_to_string(list_sort(list_filter(list_distinct(list(tier)), lambda x: x <> arg_max(tier, {RANK}))), ',') AS also, list_sort(list(value) FILTER (WHERE tier IN ('website', 'phone', 'email'))) AS evidence FROM pairs GROUP BY l_id, r_id)"""
MERGED = MERGED.replace(f"lambda x: x <> arg_max(tier, {RANK})", "lambda x: x <> top")
MERGED = MERGED.replace("FROM pairs GROUP BY l_id, r_id", f"FROM (SELECT *, first_value(tier) OVER (PARTITION BY l_id, r_id ORDER BY {RANK} DESC) AS top FROM pairs) GROUP BY l_id, r_id, top")


def pairs(t):
    left, right = (linkage.once(df) for df in sides(t))  # each tier reads its key twice
    out = linkage.short_form_pairs(left, right)
    for tier in linkage.IDENTITY:
        out = out.unionByName(linkage.key_pairs(left, right, tier, tier))
    full = lambda df: df.select("id", F.col("full_name").alias("name"))
    return out.unionByName(linkage.best_by_name(full(left), full(right)))


def merged(t):
    return linkage.merge_evidence(pairs(t))


@query("N1_left_side", f"WITH {SIDES} SELECT coalesce(l.id, r.id) AS id, CASE WHEN length(coalesce(l.name, '')) >= length(coalesce(r.name, '')) THEN l.name ELSE r.name END AS name, coalesce(nullif(l.city, ''), nullif(r.city, '')) AS city, coalesce(nullif(l.website, ''), nullif(r.website, '')) AS website, coalesce(nullif(l.email, ''), nullif(r.email, '')) AS email, coalesce(nullif(l.phone, ''), nullif(r.phone, '')) AS phone FROM ls l FULL OUTER JOIN rs r ON l.id = r.id")
def n1(t):
    left, right = (df.select("id", "name", "city", "website", "email", "phone") for df in sides(t))
    return linkage.one_side(left, right)


@query("N2_right_side", f"WITH {SIDES} SELECT id, coalesce(nullif(trim(name), ''), 'r' || id) AS name, CASE WHEN short_form <> regexp_replace(lower(name), '[^a-z0-9]', '', 'g') THEN short_form ELSE '' END AS short_form FROM rs")
def n2(t):
    """The name or else the slug; a short form that says no more than the name is none."""
    other = F.col("short_form") != X.shortform_key(F.col("name"))
    return sides(t)[1].select("id", F.coalesce(X.nonempty(F.trim("name")), F.concat(F.lit("r"), "id")).alias("name"), F.when(other, F.col("short_form")).otherwise("").alias("short_form"))


SIGNALS = ("website", "phone", "email", "short_form")


@query("N3_signal_reach", f"WITH {SIDES} " + " UNION ALL ".join(f"SELECT '{s}' AS side, {', '.join(f'''count(nullif({c}, '')) AS {c}''' for c in SIGNALS)} FROM {tbl}" for s, tbl in (("left", "ls"), ("right", "rs"))))
def n3(t):
    reach = lambda df, s: df.agg(*(F.count(X.nonempty(F.col(c))).alias(c) for c in SIGNALS)).select(F.lit(s).alias("side"), *SIGNALS)
    left, right = sides(t)
    return reach(left, "left").union(reach(right, "right"))


def tier_query(tier: str):
    @query(f"N4_{tier}_tier", f"WITH {SIDES} SELECT l_id, r_id, score, value FROM ({tier_sql(tier, tier)})")
    def run(t):
        return linkage.key_pairs(*sides(t), tier, tier).select("l_id", "r_id", "score", "value")


for _tier in linkage.IDENTITY:
    tier_query(_tier)


@query("N5_short_form_tier", f"WITH {SIDES} SELECT l_id, r_id, score FROM ({SHORT_SQL})")
def n5(t):
    return linkage.short_form_pairs(*sides(t)).select("l_id", "r_id", "score")


@query("N7_blocked_best_match", f"WITH {SIDES}, {best_sql()} SELECT l_id, r_id, score, verdict FROM nm")
def n7(t):
    full = lambda df: df.select("id", F.col("full_name").alias("name"))
    return linkage.best_by_name(*(full(df) for df in sides(t))).select("l_id", "r_id", "score", "verdict")


@query("N8_merged_evidence", f"WITH {ALL}, {MERGED} SELECT l_id, r_id, tier, score, verdict, also, coalesce(array_to_string(evidence, ','), '') AS evidence FROM merged")
def n8(t):
    return merged(t).withColumn("evidence", F.array_join("evidence", ","))


# matches that are stored from an earlier build: every third pair of equal ids, some of them judged
STORED = "SELECT college_id AS l_id, college_id AS r_id, CASE WHEN college_id % 2 = 0 THEN 'no' ELSE 'pending' END AS verdict, CASE college_id % 4 WHEN 0 THEN 'judge' WHEN 1 THEN 'rule' WHEN 2 THEN 'human' ELSE 'rule' END AS decided_by, CAST(1 AS BIGINT) AS build FROM {colleges} WHERE college_id % 3 = 0"


def stored(t):
    return t.spark.sql(STORED, colleges=t.colleges)


def persisted(t):
    """The new build written over the stored matches: what a judge or a person decided stays decided."""
    new = merged(t).select("l_id", "r_id", "verdict", F.lit(2).cast("long").alias("build"))
    old = stored(t)
    both = merge.upsert(old.withColumn("_kept", F.col("verdict")), new, ["l_id", "r_id"])
    judged = F.col("decided_by").isin("judge", "human")
    return both.select("l_id", "r_id", F.when(judged, F.col("_kept")).otherwise(F.col("verdict")).alias("verdict"), F.coalesce("decided_by", F.lit("rule")).alias("decided_by"), "build")


PERSISTED = f"""stored AS ({STORED.format(colleges='colleges')}), kept AS (SELECT coalesce(m.l_id, s.l_id) AS l_id, coalesce(m.r_id, s.r_id) AS r_id, CASE WHEN s.decided_by IN ('judge', 'human') OR m.l_id IS NULL THEN s.verdict ELSE m.verdict END AS verdict,
 coalesce(s.decided_by, 'rule') AS decided_by, CASE WHEN m.l_id IS NULL THEN s.build ELSE 2 END AS build FROM merged m FULL OUTER JOIN stored s ON m.l_id = s.l_id AND m.r_id = s.r_id)"""


@query("J7_judged_verdicts_stay", f"WITH {ALL}, {MERGED}, {PERSISTED} SELECT l_id, r_id, verdict, decided_by, CAST(build AS BIGINT) AS build FROM kept")
def j7(t):
    return persisted(t)


@query("N9_leftovers", f"WITH {ALL}, {MERGED}, {PERSISTED} SELECT count(*) AS n, count(*) FILTER (WHERE build = 2) AS latest, count(*) FILTER (WHERE build < 2) AS leftover, count(*) FILTER (WHERE decided_by IN ('judge', 'human')) AS decided FROM kept")
def n9(t):
    return persisted(t).agg(n(), F.count_if(F.col("build") == 2).alias("latest"), F.count_if(F.col("build") < 2).alias("leftover"), F.count_if(F.col("decided_by").isin("judge", "human")).alias("decided"))


@query("N10_match_report", f"WITH {ALL}, {MERGED} SELECT tier, verdict, count(*) AS n, round(avg(score), 3) AS mean_score FROM merged GROUP BY tier, verdict")
def n10(t):
    return merged(t).groupBy("tier", "verdict").agg(n(), F.round(F.avg("score"), 3).alias("mean_score"))


@query("N10_match_coverage", f"WITH {ALL}, {MERGED} SELECT count(DISTINCT l_id) FILTER (WHERE verdict = 'yes') AS matched, count(*) FILTER (WHERE verdict = 'pending') AS pending, (SELECT count(*) FROM colleges) AS total, round(100.0 * count(DISTINCT l_id) FILTER (WHERE verdict = 'yes') / (SELECT count(*) FROM colleges), 1) AS percent, (SELECT count(*) FROM (SELECT r_id FROM merged WHERE verdict = 'yes' GROUP BY r_id HAVING count(*) > 1)) AS contested FROM merged")
def n10_coverage(t):
    rows = merged(t)
    by_left = rows.groupBy("l_id").agg(F.bool_or(F.col("verdict") == "yes").alias("yes"), F.count_if(F.col("verdict") == "pending").alias("p"))
    one = by_left.agg(F.count_if("yes").alias("matched"), F.coalesce(F.sum("p"), F.lit(0)).alias("pending"))
    claimed = rows.where("verdict = 'yes'").groupBy("r_id").agg(n()).where("n > 1").agg(n("contested"))
    total = t.colleges.agg(n("total"))
    out = one.join(claimed).join(total)  # single rows
    return out.select("matched", "pending", "total", F.round(100.0 * F.col("matched") / F.col("total"), 1).alias("percent"), "contested")


KIND = f"""claims AS (SELECT m.r_id, lower(l.name) AS nm, {TOKENS.format(x='l.name')} AS tk, m.evidence FROM merged m JOIN ls l ON l.id = m.l_id WHERE m.verdict = 'yes'),
 grp AS (SELECT r_id, count(*) AS n_claims, min(len(coalesce(evidence, []))) AS least, max(len(coalesce(evidence, []))) AS most, min(evidence[1]) AS v1, max(evidence[1]) AS v2 FROM claims GROUP BY r_id HAVING count(*) > 1),
 two AS (SELECT a.r_id, min(CASE WHEN len(a.tk) > 0 AND len(b.tk) > 0 THEN CAST(len(list_intersect(a.tk, b.tk)) AS DOUBLE) / (len(a.tk) + len(b.tk) - len(list_intersect(a.tk, b.tk))) ELSE 0 END) AS j, bool_or(a.nm <> b.nm AND contains(b.nm, a.nm)) AS inside FROM claims a JOIN claims b ON a.r_id = b.r_id GROUP BY a.r_id),
 kinds AS (SELECT r_id, n_claims, CASE WHEN j >= 0.8 THEN 'duplicate' WHEN least = 1 AND most = 1 AND v1 = v2 THEN 'shared-signal' WHEN inside THEN 'parent-child' ELSE 'ambiguous' END AS kind FROM grp JOIN two USING (r_id))"""


@query("N11_conflicts", f"WITH {ALL}, {MERGED}, {KIND} SELECT r_id, n_claims, kind FROM kinds")
def n11(t):
    return linkage.conflicts(merged(t), sides(t)[0])


@query("N11_tier_sets", f"WITH {ALL}, {MERGED}, {KIND}, sets AS (SELECT r_id, array_to_string(list_sort(list_distinct(list(tier))), '+') AS tiers FROM merged WHERE verdict = 'yes' GROUP BY r_id HAVING count(*) > 1) SELECT tiers, count(*) AS n FROM sets GROUP BY tiers")
def n11_tiers(t):
    """Which evidence contested right rows rest on."""
    yes = merged(t).where("verdict = 'yes'").groupBy("r_id").agg(n("m"), F.array_join(F.array_sort(F.collect_set("tier")), "+").alias("tiers")).where("m > 1")
    return yes.groupBy("tiers").agg(n())


PENDING = "SELECT m.l_id, m.r_id, m.score, l.name AS l_name, r.name AS r_name, l.city AS l_city, r.city AS r_city FROM merged m JOIN ls l ON l.id = m.l_id JOIN rs r ON r.id = m.r_id WHERE m.verdict = 'pending' ORDER BY m.score DESC, m.l_id, m.r_id LIMIT 500"


@query("B10_ambiguous_band", f"WITH {ALL}, {MERGED} {PENDING}")
def b10(t):
    """Undecided pairs with what is known of both sides, likeliest first."""
    left, right = sides(t)
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("city").alias(f"{p}_city"))
    band = merged(t).where("verdict = 'pending'").select("l_id", "r_id", "score").join(side(left, "l"), "l_id").join(side(right, "r"), "r_id")
    return band.orderBy(F.desc("score"), "l_id", "r_id").limit(500).select("l_id", "r_id", "score", "l_name", "r_name", "l_city", "r_city")


JUDGED = "SELECT college_id AS l_id, college_id AS r_id, CASE college_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' WHEN 3 THEN '' ELSE NULL END AS verdict FROM {colleges}"


@query("N12_judgement_applied", f"WITH {ALL}, {MERGED}, j AS ({JUDGED.format(colleges='colleges')}) SELECT m.l_id, m.r_id, CASE WHEN j.verdict IN ('yes', 'no') THEN j.verdict ELSE m.verdict END AS verdict, CASE WHEN j.verdict IN ('yes', 'no') THEN 'judge' ELSE 'rule' END AS decided_by FROM merged m LEFT JOIN j ON m.l_id = j.l_id AND m.r_id = j.r_id")
def n12(t):
    """Verdicts come back from a judge; other words than yes and no are not taken."""
    judged = t.spark.sql(JUDGED, colleges=t.colleges).where(F.col("verdict").isin("yes", "no")).select("l_id", "r_id", F.col("verdict").alias("said"))
    out = merged(t).join(judged, ["l_id", "r_id"], "left")
    return out.select("l_id", "r_id", F.coalesce("said", "verdict").alias("verdict"), F.when(F.col("said").isNotNull(), "judge").otherwise("rule").alias("decided_by"))


@query("G13_rarest_words", f"WITH {SIDES}, rx AS (SELECT unnest({TOKENS.format(x='full_name')}) AS token FROM rs), dfs AS (SELECT token, count(*) AS df FROM rx GROUP BY token), lx AS (SELECT id, unnest({TOKENS.format(x='full_name')}) AS token FROM ls) SELECT id, token, df, pos FROM (SELECT id, lx.token, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY id ORDER BY coalesce(df, 0), lx.token) AS pos FROM lx LEFT JOIN dfs ON dfs.token = lx.token) WHERE pos <= 3")
def g13(t):
    from pyspark.sql import Window

    left, right = sides(t)
    word = lambda df: df.select("id", F.explode(X.tokens(F.col("full_name"))).alias("token"))
    df = word(right).groupBy("token").agg(n("df"))
    asked = word(left).join(df, "token", "left").fillna(0, ["df"])
    return asked.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))).where("pos <= 3").select("id", "token", "df", "pos")


NAMED = "SELECT course_id AS id, concat(name, ' ', course_type, ' ', regexp_replace(stream, '[^A-Za-z0-9]', '', 'g')) AS full_name FROM courses"


def overlap_sql() -> str:
    """Each side against the other and itself: the best similarity of each row, opened blocks as everywhere."""
    parts = []
    for side, a, b in (("left", 1, 0), ("right", 0, 1), ("left-self", 1, 1), ("right-self", 0, 0)):
        entries = lambda k: f"(SELECT min(id) AS id, count(*) AS n, array_to_string({TOKENS.format(x='full_name')}, ' ') AS full_name FROM named WHERE id % 2 = {k} GROUP BY 3)"  # noqa: E731, B023
        parts.append(f"SELECT '{side}' AS side, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE score >= 0.99), 0) AS BIGINT) AS n_strict, CAST(coalesce(sum(n) FILTER (WHERE score >= 0.6), 0) AS BIGINT) AS n_loose FROM {entries(a)} e LEFT JOIN (WITH ls AS {entries(a)}, rs AS {entries(b)}, {best_sql(least=0.6)} SELECT l_id, score FROM nm) x ON x.l_id = e.id")
    return f"WITH named AS ({NAMED}) " + " UNION ALL ".join(parts)


@query("N13_overlap", overlap_sql())
def n13(t):
    """How much two harvests of courses (odd and even ids) agree by name, both ways, and each with itself."""
    named = t.courses.select(F.col("course_id").alias("id"), F.concat_ws(" ", "name", "course_type", F.regexp_replace("stream", "[^A-Za-z0-9]", "")).alias("name"))
    return linkage.overlap(named.where("id % 2 = 1"), named.where("id % 2 = 0"))


SLUG = r"regexp_replace(regexp_replace(lower(concat(name, ' ', CAST(course_id AS STRING))), '[^a-z0-9]+', '-', 'g'), '-[0-9]+$', '')"


@query("N13_slug_agreement", f"SELECT n, agreed, round(100.0 * agreed / n, 1) AS percent FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {TOKENS.format(x=SLUG)} = {TOKENS.format(x='name')}) AS agreed FROM courses)")
def n13_slugs(t):
    """Slugs that say the same words as the name once their trailing number is gone."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", "name", "course_id")), "[^a-z0-9]+", "-"), "-[0-9]+$", "")
    same = F.array_sort(X.tokens(slug)) == F.array_sort(X.tokens(F.col("name")))
    return t.courses.agg(n(), F.count_if(same).alias("agreed")).withColumn("percent", F.round(100.0 * F.col("agreed") / F.col("n"), 1))
