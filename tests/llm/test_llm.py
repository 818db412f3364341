"""Each operator against a plain brute-force version, and the cases every operator must bear."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontam, licenses, linededup, lm, quality, sentencepieces, sharding, simhash, tokencount, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "one two three", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "en", "b"), (1, "one two three", "en", "a"),
    (None, "null id", "en", "b"), (5, "x " * 30_000, "en", "b"), (6, "é\x00z ▁ 日本 😀\n\nend", "xx", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    clash = ("shard", "slot", "id", "cell", "label", "n", "score", "part", "same", "a", "b", "line", "pages", "quality")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_sharding_law(docs, odd, empty, tmp_path):
    for df in (docs, odd.drop("shard", "slot")):
        rows = sharding.op1_sharding(df).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert len(rows) == df.count()
        sizes = [len(by[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    have = sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows)
    assert have == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert sharding.op1_sharding(empty).count() == 0
    out = sharding.shard_documents(docs, 3, bucket_bytes=50_000)
    assert sorted(out.select("doc_id").collect()) == sorted(docs.select("doc_id").collect())
    assert out.orderBy("shard", "slot").collect() == sharding.shard_documents(docs.repartition(5), 3, bucket_bytes=50_000).orderBy("shard", "slot").collect()
    order = [r.doc_id for r in out.orderBy("shard", "slot").collect()]
    assert order != sorted(order)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 3


def test_copies_of_one_row_are_dealt_out(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text again").alias("text")).union(spark.range(5_000).select("id", F.col("id").cast("string")))
    tagged, n, _ = sharding.scattered(rows, 1, 20_000)
    sizes = [r["count"] for r in tagged.groupBy("_gl_bucket").count().collect()]
    assert n == 105_000 and max(sizes) < 1.3 * n / len(sizes) and len(sizes) > 50
    out = sharding.shard_documents(rows, 7, bucket_bytes=20_000)
    assert out.count() == n and out.groupBy("shard").agg((F.max("slot") + 1).alias("n"), F.countDistinct("slot").alias("d")).where("n <> d or n <> 15000").count() == 0


def brute_lm(rows):
    """Base scores and the backoff model, one text at a time."""
    train = [words(t) + [None] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + lm.ADD) / (n + lm.ADD * (v + 1)))
    pairs = Counter(p for t in train for p in zip(["start", *t], t))
    total = lambda u: len(train) if u == "start" else c[u]
    arcs = {p: k for p, k in pairs.items() if k >= lm.LEAST}
    left = defaultdict(lambda: 1.0)
    for (u, _), k in arcs.items():
        left[u] -= (k - lm.DISCOUNT) / total(u)
    out = []
    for i, t in rows:
        toks = words(t) + [None]
        score = 0.0
        for u, w in zip(["start", *toks], toks):
            share = (arcs[u, w] - lm.DISCOUNT) / total(u) if (u, w) in arcs else 0.0
            score += math.log10(share + left[u] * 10 ** base(w))
        out.append((i, len(toks), sum(c[w] > 0 for w in toks), n, round(sum(map(base, toks)), 6), round(score, 6)))
    return out


def test_lm_scoring(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        have = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.op2_lm_scoring(df).collect()]
        key = lambda r: (r[0] or -1, r[1:])
        for a, b in zip(sorted(have, key=key), sorted(brute_lm(rows), key=key), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-4)
    assert lm.op2_lm_scoring(empty).count() == 0


def test_lm_blocks_do_not_matter(docs):
    training = F.col("doc_id") % 3 > 0
    one = {r.doc_id: r for r in lm.score_documents(docs, training).collect()}
    for r in lm.score_documents(docs, training, block_bytes=20_000).collect():
        assert r[:4] == one[r.doc_id][:4] and r[4:] == pytest.approx(one[r.doc_id][4:], abs=1e-6)


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: re.findall(r"[^\W_]+", r.text.lower()) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        t = " ".join(re.findall(r"[^\W_]+", (r.text or "").lower()))
        want |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in f" {t} "}
    have = {(r.doc_id, r.item_id) for r in decontam.op3_decontamination(docs, bench).collect()}
    assert want and want <= have
    assert have == {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, block_bytes=3000).collect()}  # in blocks
    passage = [f"w{i}" for i in range(40)]
    near = list(passage)
    near[7] = near[19] = near[30] = "other"
    rows = [(1, "a b " + " ".join(near) + " c"), (2, " ".join(f"z{i}" for i in range(60))), (3, " ".join(passage[:8])), (4, None), (5, " ".join(passage[10:25]))]
    b = spark.createDataFrame([(9, " ".join(passage)), (10, ""), (11, None), (12, "tiny item")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b).collect()}
    assert set(got) == {1, 5} and (got[1].first_token, got[1].end_token, got[1].n_matched) == (2, 42, 37)
    assert decontam.contaminated(odd, b).count() == 0 and decontam.contaminated(empty, b).count() == 0
    assert decontam.drop_contaminated(odd, b).count() == len(ODD)


def test_overlap_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item = rng.integers(1, 50, 30)
        text = rng.integers(50, 90, 60)
        text[15:45] = item
        text[rng.integers(0, 60, rng.integers(0, 14))] = 99
        same = text[15:45] == item
        best = 0
        for a in range(30):
            for z in range(a + decontam.MIN_TOKENS, 31):
                if same[a] and same[z - 1] and same[a:z].sum() >= (1 - decontam.MAX_SUBSTITUTED) * (z - a) - 1e-9:
                    best = max(best, z - a)
        found = decontam.best_overlap(text, item, 15)
        assert (found[1] - found[0] if found else 0) == best


def brute_repeats(w, k=8):
    grams = defaultdict(list)
    for i in range(len(w) - k + 1):
        grams[tuple(w[i : i + k])].append(i)
    return len({j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + k)})


def test_quality(docs, odd, empty):
    for df in (docs, odd):
        rows = {}
        for r in quality.op4_quality(df).collect():
            rows.setdefault(r.doc_id, r)
        for r in df.select("doc_id", "text").collect():
            t, got = r.text or "", rows[r.doc_id]
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), brute_repeats(w))
            assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
            assert got.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.op4_quality(empty).count() == 0
    text = "A good line of plain words that goes on for a while, and then on again.\nHome | News | Sport | About | Contact\nAll rights reserved.\nAnother good line of plain words that ends here."
    got = quality.quality_report(docs.sparkSession.createDataFrame([(text,)], "text string")).first().quality
    assert got.clean_text == "\n".join((text.split("\n")[0], text.split("\n")[3])) and got.kept
    for line in ("A TITLE OF SIX WORDS, IN CAPITALS.", "just a heading", "see https://a.b/c www.d.e here.", "Tous droits réservés.", "wow!! what!! a!! deal."):
        assert not quality.quality_report(docs.sparkSession.createDataFrame([(line,)], "text string")).first().quality.clean_text
    for line in ("", "A line of words that ends.", "See https://a.b/c for more on this.", "A WHO report."):
        assert quality.quality_report(docs.sparkSession.createDataFrame([(line,)], "text string")).first().quality.clean_text == line


def test_sentencepiece(docs, odd, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.VOCABULARY)
    for df in (docs, odd):
        coded = sentencepieces.encode(df)
        for r in coded.collect():
            assert r.pieces.ids == model.encode(r.text or "")
            assert r.pieces.exact == ("▁" not in (r.text or ""))
        back = sentencepieces.decode(coded.select("text", F.col("pieces.ids").alias("ids")).withColumnRenamed("text", "was"))
        assert back.where("coalesce(was, '') <> text and not contains(was, '▁')").count() == 0
    assert sentencepieces.op5_sentencepiece(empty).count() == 0


def test_sentencepiece_random():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.VOCABULARY)
    coder, rng = sentencepieces.PieceCoder(), np.random.default_rng(3)
    alphabet = list("aabcdeeeinorstt  \n.,é1\t") + ["the", "ing", "tion", "中", "\x01", "ß"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(1500)]
    assert coder.encode_batch(texts) == model.encode(texts)


def test_toxicity(spark, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    out = toxicity.op6_toxicity(big, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in out if r.toxic]
    assert sum(r.predicted for r in hit) >= 0.65 * len(hit)  # a tenth of the toxic labels is on texts without a toxic word
    assert sum(r.predicted for r in out if not r.toxic) <= 0.04 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    few = spark.createDataFrame([(1, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op6_toxicity(odd, few).count() == len(ODD)
    assert toxicity.op6_toxicity(empty, few).count() == 0
    assert toxicity.op6_toxicity(odd, few.limit(0)).where("score between 0 and 1").count() == len(ODD)


def test_chain_by_enumeration():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 0, 1, 5])
    emission, arcs = rng.normal(size=sizes.sum()), rng.normal(size=(2, 2))
    p, _ = toxicity.chain(emission, sizes, arcs)
    at, want = 0, []
    for n in sizes:
        total, marginal = 0.0, np.zeros(n)
        for code in range(2**n if n else 0):
            y = [code >> i & 1 for i in range(n)]
            weight = math.exp(sum(emission[at + i] for i in range(n) if y[i]) + sum(arcs[y[i], y[i + 1]] for i in range(n - 1)))
            total += weight
            marginal += weight * np.array(y)
        want += list(marginal / total) if n else []
        at += n
    assert p == pytest.approx(want)


def test_toxic_spans():
    text = "You İ are a total idiot, really"
    p = np.array([0.0 if w not in ("total", "idiot") else 0.9 for w in toxicity.TOKEN.findall(text)])
    (span,) = toxicity.spans_of(text, p)
    assert text[span["start"] : span["end"]] == "total idiot"


def test_line_dedup(docs, odd, empty):
    docs = docs.withColumn("source", F.expr("concat('s', doc_id % 3)"))
    got = {r.doc_id: r for r in linededup.op7_line_dedup(docs).collect()}
    pages = defaultdict(set)
    for r in docs.collect():
        pages[r.source or ""].add(r.text or "")
    drops = {}
    for host, texts in pages.items():
        c = Counter(x for t in texts for x in set(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x))
        drops[host] = {x for x, n in c.items() if n >= linededup.MIN_PAGES and n > linededup.MAX_RATIO * len(texts)}
    assert any(drops.values())
    for r in docs.collect():
        assert got[r.doc_id].text == "\n".join(x for x in r.text.split("\n") if x not in drops[r.source])
    shuffled = linededup.drop_boilerplate(docs.select("doc_id", "source", "text"), broadcast_lines=1)
    assert sorted(shuffled.collect()) == sorted(linededup.op7_line_dedup(docs).collect())
    out = linededup.drop_boilerplate(odd)
    assert out.count() == len(ODD) and out.columns == [*odd.columns, "n_dropped_lines"]
    assert out.where("text is null").count() == 1
    assert linededup.op7_line_dedup(empty).count() == 0


def brute_fingerprint(text, k=3):
    w = words(text)
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, budget):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, odd, empty):
    for df in (docs, odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
        ids, fps = [r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows]
        comp = [ids[i] for i in brute_components(fps, 2)]
        want = sorted((i or -1, f"{f:016x}", c or -1) for i, f, c in zip(ids, fps, comp))
        assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.op8_simhash(df).collect()) == want
    assert simhash.op8_simhash(empty).count() == 0


@pytest.mark.parametrize("cell_rows", [16, 2048])
def test_trie_join(spark, cell_rows):
    """Dense groups of near fingerprints, with cells that must be cut into chunks."""
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**63, 100)}
    for c in list(fps)[:5]:
        for _ in range(60):
            fps.add(c ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    fps = sorted(fps)
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, fp long")
    links = simhash.cell_links(simhash.run_cells(df, 2, cell_rows), 2, cell_rows=cell_rows)
    found = {r.id: r.component for r in simhash.components(links).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, 2)


def test_components_long_chain(spark):
    links = spark.range(300).selectExpr("id * 7919 % 301 as a", "(id + 1) * 7919 % 301 as b")
    assert {r.component for r in simhash.components(links).collect()} == {0}


def test_near_groups(spark, odd, empty):
    rng = np.random.default_rng(4)
    texts, of = [], []
    for k in range(25):
        text = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        for copy in range(4):
            t = list(text)
            for i in rng.integers(0, 300, copy * 2):
                t[i] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(t))
            of.append(k)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.id: r.group for r in simhash.near_groups(df).collect()}
    shingles = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            similarity = len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
            if similarity >= 0.9:
                assert groups[i] == groups[j]
            if of[i] != of[j]:
                assert groups[i] != groups[j]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                root = [root[j] if r == root[i] else r for r in root]
    assert all(root[i] == root[g] for i, g in groups.items())  # nothing is joined without a link
    kept = {r.doc_id for r in simhash.drop_near_copies(df).collect()}
    assert kept == {min(i for i in groups if groups[i] == g) for g in groups.values()}
    assert simhash.drop_near_copies(odd).count() == len(ODD)  # equal ids are one document
    assert simhash.drop_near_copies(empty).count() == 0


def test_token_counts(docs, odd, empty):
    pieces = tokencount.pieces_of(tokencount.VOCABULARY)
    known, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            k = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in known), 0)
            if not k:
                return 0
            n, word = n + 1, word[k:]
        return n

    for df in (docs, odd):
        want = []
        for r in df.select("doc_id", "text").collect():
            counts = [greedy("▁" + w) for w in (r.text or "").split()[:2000]] + [greedy("▁x")] * max(0, len((r.text or "").split()) - 2000)
            want.append((-1 if r.doc_id is None else r.doc_id, len(counts), sum(c or 1 for c in counts), counts.count(0)))
        if df is odd:
            assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in tokencount.op9_token_counts(df).collect()) == sorted(want)
        else:
            have = {r.doc_id: tuple(r) for r in tokencount.op9_token_counts(df).collect()}
            assert all(have[w[0]] == w for w in want if w[1] < 2000)
    assert tokencount.op9_token_counts(empty).count() == 0


def test_license_scan(docs, odd, empty):
    for df in (docs, odd):
        for r in licenses.scan(df).collect():
            assert r.score == 0 or r.labels
        got = {(r.doc_id, r.n_words): r for r in licenses.op10_license_scan(df).collect()}
        for r in df.select("doc_id", "text").collect():
            low = (r.text or "").encode().lower()
            w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
            at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
            x = got[r.doc_id, len(w)]
            assert (x.n_base, x.first_word, x.last_word) == (len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
            assert x.base_labels == ",".join(sorted({k for _, k in at})) and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))
    assert licenses.op10_license_scan(empty).count() == 0
    scanner = licenses.Scanner()
    assert len(scanner.rules) > 300
    (hit,) = scanner.detections("this work is licensed under the gnu general public license, version 3.")
    assert (hit[2].label, hit[2].priority) == ("gpl", 10)
    assert [r.label for *_, r in scanner.detections("spdx-license-identifier: apache-2.0")] == ["apache"]
    assert [r.label for *_, r in scanner.detections("licensed under cc by-nc 4.0. released under the mit license.")] == ["cc-by-nc", "mit"]


def test_license_prefilter_changes_nothing(docs):
    scanner = licenses.Scanner()
    every = [(i, re.compile(r.pattern)) for i, r in enumerate(scanner.rules)]
    texts = [r.text.lower() for r in docs.where("lower(text) like '%licen%' or lower(text) like '%copyright%'").limit(20).collect()]
    texts += ["gpl-2.0 and bsd 3-clause license", "creative commons attribution license version 4.0", "lesser gpl license v2.1", "cc0-1.0", "mulan psl license v2"]
    for t in texts:
        found = sorted((scanner.rules[i].priority, -(m.end() - m.start()), i, m.start(), m.end()) for i, p in every for m in p.finditer(t) if m.end() > m.start())
        taken = []
        for _, _, i, a, z in found:
            if not any(a >= x and z <= y for x, y, _ in taken):
                taken.append((a, z, scanner.rules[i]))
        assert scanner.detections(t) == sorted(taken, key=lambda x: x[:2])


def test_pipeline(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "encoding":
            assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.join(now, "doc_id", "left_anti").count() == 0
            now = out.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else out
    assert out.count() == now.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in now.collect())
