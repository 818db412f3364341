"""Every catalogue query against its SQL, and the operators on small fixtures."""

import gzip
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gleaner.functions import payload, records
from gleaner.functions import text as X
from gleaner.operators import cdc, linkage, merge
from gleaner.operators import relational as R
from gleaner.plans import catalogue
from gleaner.sources import pages, sinks
from gleaner.streaming import promote

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if math.isfinite(v) else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in catalogue.SQL:
        found = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_write_policies(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "", "y"), (3, "c", None)], "id long, v string, w string")
    new = spark.createDataFrame([(1, "", 1), (2, "B", 1), (4, "d", 1), (4, "e", 2), (None, "z", 1)], "id long, v string, seq int")
    batch = merge.last_wins(new, ["id"], ["seq"]).drop("seq")
    got = lambda df: {r.id: (r.v, r.w) for r in df.collect()}
    assert got(merge.upsert(old, batch, ["id"])) == {1: ("", "x"), 2: ("B", "y"), 3: ("c", None), 4: ("e", None)}
    assert got(merge.upsert(old, batch, ["id"], merge.preserve))[1] == ("a", "x")
    assert got(merge.upsert(old, batch, ["id"], merge.fill_empty)) == {1: ("a", "x"), 2: ("B", "y"), 3: ("c", None), 4: ("e", None)}
    assert got(merge.insert_if_absent(old, batch, ["id"])) == {1: ("a", "x"), 2: ("", "y"), 3: ("c", None), 4: ("e", None)}
    assert set(got(merge.update_only(old, batch, ["id"]))) == {1, 2, 3}
    guarded = merge.upsert(old, batch, ["id"], guard=F.col("t.w") == "y")
    assert got(guarded) == {1: ("a", "x"), 2: ("B", "y"), 3: ("c", None), 4: ("e", None)}


def test_reconcile(spark):
    kinds = "id long, fee double, name string"
    was = spark.createDataFrame([(1, 10.0, "a"), (2, 5.0, "b"), (3, 1.5, "c"), (5, 2.0, " e ")], kinds)
    before = cdc.with_fingerprint(was, ["fee", "name"]).withColumn("inactive_since", F.when(F.col("id") == 3, "2024"))
    after = spark.createDataFrame([(1, 10.0, "a"), (2, 6.0, "B"), (3, 1.5, "c"), (4, None, ""), (5, 2.0, "e")], kinds)
    got = {r.id: (r.verdict, r.n_fields) for r in cdc.reconcile(before, after, ["id"], ["fee", "name"]).collect()}
    assert got == {1: ("same", 0), 2: ("changed", 2), 3: ("returned", 0), 4: ("new", 0), 5: ("same", 0)}
    changes = {(r.id, r.field): (r.old_value, r.new_value) for r in cdc.field_changes(was, after, ["id"], ["fee", "name"]).collect()}
    assert changes == {(2, "fee"): ("5", "6"), (2, "name"): ("b", "B")}


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    fees = {"₹ 1.5 Lakh": 150_000, "2 crores": 20_000_000, "INR 12,500": 12_500, "7k": 7000, "1.2.3": None, "free": None, "2.5": 2}
    for t, want in fees.items():
        assert one(X.fee_to_units(F.lit(t))) == want
    assert one(X.duration_months(F.lit("2 years 6 months"))) == 30 and one(X.duration_months(F.lit("long"))) is None
    assert one(X.domain(F.lit("Mail@WWW.Site.ac.in:80/x?y"))) == "site.ac.in" and one(X.domain(F.lit("none"))) is None
    assert one(X.phone_key(F.lit("+91 98-7654 3210"))) == "9876543210" and one(X.phone_key(F.lit("123"))) == ""
    assert one(X.tokens(F.lit("The R.R. Institute of X-Ray 2020"))) == ["rr", "institute", "x", "ray"]
    assert one(X.tokens(F.lit("S.R College"))) == one(X.tokens(F.lit("S R College"))) == ["sr", "college"]
    assert one(X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_linkage(spark):
    kinds = "id long, name string, website string, phone string"
    left = spark.createDataFrame([(1, "Alpha Institute Pune", "alpha.org", ""), (2, "Beta College Delhi", "", "9876543210"), (3, "Gamma School", "shared.org", "")], kinds)
    right = spark.createDataFrame(
        [(10, "Alpha Institute Pune", "alpha.org", ""), (11, "Alpha Nursing", "alpha.org", ""), (12, "Beta College Delhi", "", "9876543210")]
        + [(20 + i, f"Other {i}", "shared.org", "") for i in range(5)], kinds)
    web = {(r.l_id, r.r_id): r.score for r in linkage.key_pairs(left, right, "website", "website").collect()}
    assert web == {(1, 10): 0.9, (1, 11): 0.9}  # a key of five rows links nothing
    names = {r.l_id: (r.r_id, r.score, r.verdict) for r in linkage.best_by_name(left, right).collect()}
    assert names[1] == (10, 1.0, "yes") and names[2] == (12, 1.0, "yes") and 3 not in names
    pairs = linkage.key_pairs(left, right, "website", "website").unionByName(linkage.best_by_name(left, right))
    merged = {(r.l_id, r.r_id): r for r in linkage.merge_evidence(pairs).collect()}
    assert (merged[1, 10].tier, merged[1, 10].score, merged[1, 10].also) == ("website", 1.0, "name")
    claims = spark.createDataFrame(
        [(1, 7, "website", "yes", ["a.b"]), (2, 7, "website", "yes", ["a.b"]), (3, 8, "name", "yes", []), (1, 9, "phone", "yes", ["1"]), (2, 9, "phone", "yes", ["2"]), (3, 9, "name", "pending", []), (2, 10, "email", "yes", ["c"]), (3, 10, "name", "yes", [])],
        "l_id long, r_id long, tier string, verdict string, evidence array<string>")
    two = spark.createDataFrame([(1, "Pune University"), (2, "Pune University School"), (3, "x")], "id long, name string")
    kinds = {r.r_id: (r.n_claims, r.kind) for r in linkage.conflicts(claims, two).collect()}
    assert kinds == {7: (2, "shared-signal"), 9: (2, "parent-child"), 10: (2, "ambiguous")}  # values must be equal, one for each


def best_match(left, right, cap, least):
    """Blocks opened rarest first until more than ``cap`` distinct rows were seen, over all rows of a block."""
    out = {}
    for i, name in left:
        bag = set(name.split())
        count = lambda w: sum(w in n.split() for _, n in right)
        best, seen = None, set()
        for word in sorted(bag, key=lambda w: (count(w), w))[:3]:
            for j, other in right:
                if word in other.split() and j not in seen:
                    seen.add(j)
                    both = set(other.split())
                    score = len(bag & both) / len(bag | both)
                    if best is None or score > best[1]:
                        best = (j, score)
            if len(seen) > cap:
                break
        if best and best[1] >= least:
            out[i] = (best[0], round(best[1], 6))
    return out


def test_best_by_name_against_brute_force(spark):
    """Common words, equal names, long names, and caps that close blocks after distinct rows."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)] + ["common"] * 4 + ["often"] * 2
    name = lambda k: " ".join(sorted({rng.choice(words) for _ in range(k)}, key=lambda _: rng.random()))
    left = [(i, name(rng.choice((1, 2, 3, 4, 6, 18)))) for i in range(40)]
    right = [(100 + i, name(rng.choice((1, 2, 3, 4, 6, 18)))) for i in range(80)]
    left += [(90, "alpha beta gamma")]
    right += [(300, "alpha beta x1 x2"), (301, "alpha beta x1 x3"), (302, "gamma")]
    df = lambda rows: spark.createDataFrame(rows, "id long, name string")
    for cap in (3, 25, 600):
        got = {r.l_id: (r.r_id, r.score) for r in linkage.best_by_name(df(left), df(right), cap=cap).collect()}
        assert got == best_match(left, right, cap, 0.45)
    assert linkage.best_by_name(df([]), df(right)).count() == linkage.best_by_name(df(left), df([])).count() == 0
    plan = linkage.best_by_name(df(left), df(right))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_short_forms(spark):
    kinds = "id long, short_form string, city string"
    left = spark.createDataFrame([(1, "iit", "New Delhi"), (2, "iit", ""), (3, "", "Delhi"), (4, "iit", "Pune")], kinds)
    right = spark.createDataFrame([(10 + i, "iit", "Delhi") for i in range(12)] + [(50, "iit", "New Town")], kinds)
    got = {(r.l_id, r.r_id) for r in linkage.short_form_pairs(left, right).collect()}
    assert got == {(1, 10 + i) for i in range(8)}


def test_sources(spark, tmp_path):
    xml = "<urlset><url><loc>http://a/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a/2</loc></url><url><loc> http://a/3 </loc><lastmod>2024-02-02</lastmod></url><url><loc>http://a/4</loc"
    (tmp_path / "maps").mkdir()
    with gzip.open(tmp_path / "maps" / "m.xml.gz", "wt") as f:
        f.write(xml)
    read = spark.read.text(str(tmp_path / "maps"), wholetext=True).withColumnRenamed("value", "xml")
    assert [tuple(r) for r in pages.sitemap_entries(read).collect()] == [("http://a/1", "2024-01-01"), ("http://a/2", ""), ("http://a/3", "2024-02-02")]
    html = '<html><title> T </title><script id="__NEXT_DATA__" type="x">{"a": 1}</script><script>window.S = {"k": "}\\"{", "n": {"m": 2}}; more {</script><table><tr><th>Name</th></tr><tr><td><b>x</b></td><td>2</td></tr></table></html>'
    df = spark.createDataFrame([(html,), (None,), ("no state",)], "html string")
    states = [r.state for r in pages.script_state(df, "html", "window.S =").collect()]
    assert states == ['{"k": "}\\"{", "n": {"m": 2}}', None, None]
    for text, want in (("S = {'a': '}', 'b': 1} {", "{'a': '}', 'b': 1}"), ("S = {\"it's\": {'x': '\"}'}}", "{\"it's\": {'x': '\"}'}}"), ("S = {'open: 1}", None), ("S = {a: {}", None), ("S = {'\\\\': 1}", "{'\\\\': 1}")):
        assert pages.balanced_object(text, "S =") == want
    row = df.select(pages.script_json(F.col("html")).alias("j"), pages.table_rows(F.col("html")).alias("t"), pages.title(F.col("html")).alias("n")).first()
    assert (row.j, row.t, row.n) == ('{"a": 1}', [["Name"], ["x", "2"]], "T")
    nested = spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>")
    assert tuple(sinks.for_export(nested).first()) == ("1", "", "[1,2]")
    sinks.write_csv(nested, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().c == "[1,2]"


def test_packed_and_blocked_payloads(spark):
    import zlib

    packed = [gzip.compress("é".encode()), zlib.compress(b"plain"), b"text", b"\x1f\x8bno", None]
    df = spark.createDataFrame(list(enumerate(packed)), "id long, content binary")
    texts = {r.id: r.text for r in pages.decompressed(df).collect()}
    assert (texts[0], texts[1], texts[2], texts[4]) == ("é", "plain", "text", "") and "no" in texts[3]
    html = spark.createDataFrame([("<TITLE x> Just A Moment </title>",), ("fine",), ("",), (None,), ("x" * 20_000 + "__cf_chl_",)], "html string")
    assert [r.b for r in html.select(pages.block_page(F.col("html")).alias("b")).collect()] == [True, False, True, True, False]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that is run again after its version was written reads the version before it."""
    schema, at = "id long, v string, seq long", str(tmp_path)
    run = lambda point: promote.promote(spark, f"{at}/staging", f"{at}/master", f"{at}/{point}", schema, ["id"], ["seq"])
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).coalesce(1).write.parquet(f"{at}/staging")
    run("first")
    want = sorted(tuple(r) for r in promote.current(spark, f"{at}/master").collect())
    run("again")  # a checkpoint that has lost the commit: the same batch number once more
    assert sorted(tuple(r) for r in promote.current(spark, f"{at}/master").collect()) == want == [(1, "b", 2), (2, "c", 1)]


def test_observed_rows(spark):
    """Each line of the decision table: new, same, resynced, returned, changed, returned with changes."""
    kinds = "id long, v string"
    was = spark.createDataFrame([(i, f"v{i}") for i in range(2, 8)], kinds)
    before = cdc.with_fingerprint(was, ["v"]).withColumn("content_hash", F.when(F.col("id").isin(3, 5), "old rule").when(F.col("id") == 7, None).otherwise(F.col("content_hash")))
    gone = F.when(F.col("id").isin(4, 5, 6), F.lit("2024-01-01"))
    before = before.withColumns({"inactive_since": gone, "first_seen": F.lit("2020-01-01"), "last_changed": F.lit("2021-01-01")})
    after = spark.createDataFrame([(1, "x"), (2, "v2"), (3, "v3"), (4, "v4"), (5, "v5"), (6, "new" * 200), (7, "v7")], kinds)
    rows = {r.id: r for r in cdc.observed(before, after, ["id"], ["v"], "2024-06-01").collect()}
    assert {i: (r.verdict, r.resynced) for i, r in rows.items()} == {1: ("new", False), 2: ("same", False), 3: ("same", True), 4: ("returned", False), 5: ("returned", True), 6: ("returned", False), 7: ("new", False)}
    assert {i for i, r in rows.items() if r.last_changed == "2024-06-01"} == {1, 6, 7} and rows[1].first_seen == "2024-06-01" and rows[3].first_seen == "2020-01-01"
    log = {(r.id, r.change_type, r.field) for r in cdc.change_log(before, after, ["id"], ["v"]).collect()}
    assert log == {(1, "new", "*"), (4, "returned", "*"), (5, "returned", "*"), (6, "changed", "v"), (7, "new", "*")}
    long = cdc.change_log(before, after, ["id"], ["v"]).where("id = 6").first()
    assert len(long.new_value) == 401 and long.new_value.endswith("…")


def test_located_and_flattened(spark):
    rows = [(1, '{"a": {"b": {"id": 1, "name": "x"}}, "c": {"id": 2, "name": "y"}}'), (2, '[{"id": 3}, [{"id": 4, "name": "z"}]]'), (3, "7"), (4, None), (5, "{broken")]
    df = spark.createDataFrame(rows, "k long, raw string").select("k", F.try_parse_json("raw").alias("v"))
    found = {r.k: r.node for r in payload.located(df, ["id", "name"]).select("k", F.to_json("node").alias("node")).collect()}
    assert found == {1: '{"id":2,"name":"y"}', 2: '{"id":4,"name":"z"}', 3: None, 4: None, 5: None}
    flat = sorted((r.k, r.i) for r in payload.flattened(df, "id").select("k", payload.field(F.col("node"), "$.id", "long").alias("i")).collect())
    assert flat == [(1, 1), (1, 2), (2, 3), (2, 4)]


def test_guarded_select(spark):
    df = spark.range(2000)
    assert R.guarded_select(spark, " SELECT id FROM {t} ", t=df).count() == 1000
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE x", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ValueError):
            R.guarded_select(spark, bad, t=df)


def test_promotion_stream(spark, tmp_path):
    schema, at = "id long, v string, seq long", str(tmp_path)
    stage = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/staging")
    run = lambda: promote.promote(spark, f"{at}/staging", f"{at}/master", f"{at}/checkpoint", schema, ["id"], ["seq"], merge.preserve)
    stage([(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    run()
    stage([(2, "", 5), (3, "d", 1)])
    run()
    run()  # nothing new
    assert {r.id: r.v for r in promote.current(spark, f"{at}/master").collect()} == {1: "b", 2: "c", 3: "d"}


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    live = promote.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    q = live.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() == promote.windowed_counts(events).count()


def test_histogram_and_scores(spark):
    df = spark.createDataFrame([(1,), (5,), (50,), (None,)], "v int")
    assert [(r.bucket, r.n) for r in R.histogram(df, F.col("v"), ((10, "low"), (None, "high"))).collect()] == [("low", 2), ("high", 1)]
    score = R.batch_score(F.lit(0), F.lit(0.0), F.lit(0))
    assert spark.range(1).select(score).first()[0] == 50.0


def test_payload_edges(spark):
    """Missing paths, other types, empty texts and broken JSON are NULL; steps sort by number, other keys last."""
    rows = [(1, '{"a": " ", "b": "x", "n": {"k": 7}, "l": [1], "f": true, "z": null}'), (2, "{broken"), (3, None), (4, "[]")]
    df = spark.createDataFrame(rows, "id long, raw string").select("id", F.try_parse_json("raw").alias("v"))
    v = F.col("v")
    got = df.select("id", payload.first_text(v, "$.a", "$.b").alias("t"), payload.field(v, "$.n.k", "long").alias("k"), payload.field(v, "$.b", "long").alias("bad"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 7, None), (2, None, None, None), (3, None, None, None), (4, None, None, None)]
    kinds = {(r.path, r.kind) for r in payload.nodes(df).collect()}
    assert kinds == {("a", "text"), ("b", "text"), ("n", "object"), ("n.k", "number"), ("l", "list"), ("f", "flag"), ("z", "null")}
    steps = spark.sql("SELECT map('10', 'c', 'x', 'd', '2', 'b', '1', 'a') AS m").select(payload.ordered_steps(F.col("m")).alias("s"))
    assert steps.first().s == ["a", "b", "c", "d"]
    block = spark.sql("SELECT array(named_struct('label', ' Fee', 'value', '5'), named_struct('label', 'fee', 'value', '6')) AS b")
    assert tuple(block.select(*payload.label_block(F.col("b"), {"fee": "fee", "type": "type"})).first()) == ("5", None)


def test_overlap_against_brute_force(spark):
    left = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta epsilon zeta eta"), (4, "lonely"), (5, ""), (6, None)]
    right = [(10, "gamma beta alpha"), (11, "delta epsilon zeta theta"), (12, "other thing"), (13, "lonely hill")]
    df = lambda rows: spark.createDataFrame(rows, "id long, name string")
    got = {r.side: (r.n, r.n_strict, r.n_loose) for r in linkage.overlap(df(left), df(right)).collect()}

    def brute(xs, ys):
        bag = lambda s: set((s or "").split())
        best = [max((len(bag(x) & bag(y)) / len(bag(x) | bag(y)) if bag(x) and bag(y) else 0.0) for _, y in ys) for _, x in xs]
        return len(xs), sum(b >= 0.99 for b in best), sum(b >= 0.6 for b in best)

    assert got == {"left": brute(left, right), "right": brute(right, left), "left-self": brute(left, left), "right-self": brute(right, right)}
    assert [r.n for r in linkage.overlap(df([]), df([])).collect()] == [0, 0, 0, 0]


def test_record_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.absolute_url(F.lit("/a/b"), "https://h.example/")) == "https://h.example/a/b"
    assert one(X.absolute_url(F.lit(""), "https://h.example")) == ""
    assert one(records.plain_text(F.lit("<p>Fees&nbsp;&amp;\n <b>seats</b></p>"))) == "Fees & seats"
    span = lambda low, high: one(records.span_text(F.lit(low).cast("long"), F.lit(high).cast("long"), F.lit("years")))
    assert [span(2, 2), span(2, None), span(2, 4), span(None, None)] == ["2 years", "2 years", "2-4 years", ""]
    fee = lambda t: tuple(one(c) for c in records.native_fee(F.lit(t)))
    assert [fee("USD 15,000"), fee("£9.5K"), fee("free")] == [("USD", 15000), ("GBP", 9500), (None, None)]
