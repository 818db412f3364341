"""Places where an operator once did less than the whole job."""

import re
import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontam, licenses, linededup, lm, quality, sentencepieces, simhash, tokencount, toxicity


def linked(texts, similarity=0.8):
    """Smallest place that links of all pairs reach, by brute force."""
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def templates(rng, groups, copies, n=300):
    for _ in range(groups):
        text = [f"w{x}" for x in rng.integers(0, 3000, n)]
        for _ in range(copies):
            t = list(text)
            for i in rng.integers(0, n, int(rng.integers(3, 7))):
                t[i] = f"x{rng.integers(0, 10**6)}"
            yield " ".join(t)


def test_exact_links_are_not_displaced(spark):
    """Copies of one template whose pairs lie around 0.8: every true link of a candidate component counts."""
    texts = list(templates(np.random.default_rng(8), 6, 40))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(40 * (i // 40), i) for i in range(len(texts)) if i % 40], "a long, b long")
    want = linked(texts)
    assert len(set(want)) > 6
    for cell_shingles in (simhash.CELL_SHINGLES, 3000):
        held = simhash.held_links(pairs, df, 0.8, "doc_id", "text", cell_shingles)
        found = {r.id: r.component for r in simhash.components(held).collect()}
        assert [found.get(i, i) for i in range(len(texts))] == want
    groups = {r.id: r.group for r in simhash.near_groups(df).collect()}
    assert [groups[i] for i in range(len(texts))] == want


def test_candidates_by_kind_of_edit(spark):
    """Cut, extended and substituted copies of 0.8 and more all end in the group of their original."""
    rng = np.random.default_rng(9)
    texts, kinds = [], []
    for _ in range(60):
        n = int(rng.integers(60, 600))
        text = [f"w{x}" for x in rng.integers(0, 3000, n)]
        for kind, share in (("cut", 0.82), ("cut", 0.9), ("extended", 1.2), ("extended", 1.08), ("substituted", 0.02)):
            copy = text[: int(np.ceil(n * share))] + [f"y{x}" for x in rng.integers(0, 3000, max(0, int(n * share) - n))]
            if kind == "substituted":
                copy = list(text)
                for i in rng.integers(0, n, int(n * share)):
                    copy[i] = "other"
            texts += [" ".join(text), " ".join(copy)]
            kinds.append((kind, share))
    # each pair by itself: words of different pairs differ
    texts = [" ".join(f"{i // 2}{w}" for w in t.split()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.id: r.group for r in simhash.near_groups(df).collect()}
    lost = {}
    for k, kind in enumerate(kinds):
        a, b = linked(texts[2 * k : 2 * k + 2])
        if a == b and groups[2 * k] != groups[2 * k + 1]:
            lost[kind] = lost.get(kind, 0) + 1
    assert not lost


def test_rare_pairs_stay_arcs(spark):
    """A pair seen a few times is an arc however many other tokens there are."""
    few = [(i, "alpha beta") for i in range(4)]
    rng = np.random.default_rng(3)
    # over 4 million tokens: a share of 1e-6 would ask for 5 of each pair
    many = [(10 + i, " ".join(f"w{x}" for x in rng.integers(0, 500, 45_000))) for i in range(100)]
    df = spark.createDataFrame(few + many, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(df, F.lit(True)).where("doc_id < 10").collect()}
    n, v = got[0].train_tokens, 500 + 3
    base = lambda c: (c + lm.ADD) / (n + lm.ADD * (v + 1))
    assert n > 4_000_000 and abs(got[0].base_score - np.log10([base(4), base(4), base(104)]).sum()) < 1e-6
    # each step is an arc: alpha to beta and beta to the end are all that follows there
    follows = lambda c: np.log10(3.5 / 4 + 0.5 / 4 * base(c))
    start = 10 ** (got[0].score - follows(4) - follows(104))
    assert 3.5 / 104 < start < 3.5 / 104 + base(4)


def names_of(tree):
    """Every text that a pattern of a license's names matches."""
    out = [""]
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "IN":
            more = [chr(x) for op, x in value if str(op) == "LITERAL"]
        elif kind == "BRANCH":
            more = [x for branch in value[1] for x in names_of(branch)]
        elif kind == "SUBPATTERN":
            more = names_of(value[3])
        elif kind == "MAX_REPEAT":
            assert value[1] == 1
            more = names_of(value[2]) + [""] * (value[0] == 0)
        else:
            assert kind == "ASSERT_NOT"
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_license_name_passes_its_keyword():
    scanner = licenses.Scanner()
    for label, keywords, names, _ in licenses.FAMILIES:
        for name in names_of(re._parser.parse(names)):
            assert any(k in name for k in keywords.split("|")), (label, name)
            for text in (f"{name} license", f"the {name} license version 2.0", f"released under {name}"):
                for blank in (" ", "\n", "\r\n   "):
                    wrapped = text.replace(" ", blank)
                    assert label in {r.label for *_, r in scanner.detections(wrapped)}, (label, wrapped)
    for text, label in (("all rights\nreserved", "all-rights-reserved"), ("in the\npublic  domain", "public-domain")):
        assert [r.label for *_, r in scanner.detections(text)] == [label]


def test_signatures_pass_their_keywords_and_nested_spans_go():
    scanner = licenses.Scanner()
    for label, key, pattern in licenses.SIGNATURES:
        example = pattern
        for _ in range(9):  # innermost groups: their first branch
            example = re.sub(r"\(\?!-\)", "", example)
            example = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", example)
        example = re.sub(r"\[[^\]]*\](?:\{0,2\}|\{0,1\})?\??\*?", lambda m: "2" if m[0].startswith("[2") else "" if m[0].endswith(("}", "*", "?")) else '"' if '"' in m[0] else "c" if "c" in m[0] else "1" if "1" in m[0] else ":", example)
        example = re.sub(r"\.\{\d,\d+\}", "someone", example).replace(r"\b", "").replace(r"\S*", "").replace(r"\d", "0").replace("\\", "").replace(" ?", " ").replace("?", "")
        assert key in example and label in {r.label for *_, r in scanner.detections(example)}, (label, pattern, example)
    text = "permission is hereby granted, free of charge, to any person obtaining a copy of this software. released under the mit license, version 2. " * 400
    began = time.perf_counter()
    spans = scanner.detections(text)
    assert len(spans) == 800 and time.perf_counter() - began < 2


def test_every_permitted_overlap_has_a_seed():
    """Over all patterns of substitutions in overlaps of up to 19 tokens and in whole short items."""
    for n in range(1, 20):
        item = " ".join(f"w{i}" for i in range(n))
        index = decontam.SeedIndex([(1, item)])
        for k in range(int(n * decontam.MAX_SUBSTITUTED + 1e-9) + 1):
            for out in combinations(range(1, n - 1), k):
                text = np.array([0 if i in out else i + 1 for i in range(n)], dtype=np.int64)
                assert (0, 0) in set(index.hits(text)) and index.touched([text[:0], text]) == [1], (n, out)
                assert decontam.best_overlap(text, index.items[0][1], 0) == (0, n, n - k)


def test_substituted_overlaps_are_found(spark):
    """Overlaps that no mask of seven tokens fits into, and a short item with one token substituted."""
    item = [f"w{i}" for i in range(30)]
    part = item[5:20]
    part[3] = part[7] = part[11] = "other"
    rows = [(1, "a b " + " ".join(part) + " c"), (2, "s0 s1 other s3 s4 s5"), (3, "s0 other other s3 s4 s5")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "s0 s1 s2 s3 s4 s5")], "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.first_token, r.end_token, r.n_matched) for r in found} == {(1, 7, 2, 17, 12), (2, 8, 0, 6, 5)}


def test_repeated_words_against_repeated_words():
    """Hits of one word that fills text and item: every diagonal is found, and the work follows the lengths."""
    rng = np.random.default_rng(12)
    for n, m in ((40, 30), (700, 400)):
        index = decontam.SeedIndex([(1, "x " * m), (2, "a b c d e f g h " * 12)])
        assert {d for k, d in index.hits(np.ones(n, dtype=np.int64)) if k == 0} == set(range(-(m - 6), n - 5))
        assert decontam.best_by_item(index, np.ones(n, dtype=np.int64)) == {0: (0, min(n, m), min(n, m))}
    for _ in range(20):
        x, y = np.unique(rng.integers(0, 3000, 400)), np.unique(rng.integers(0, 900, 300))
        assert decontam.differences(x, y).tolist() == sorted({int(i - j) for i in x for j in y})
    index = decontam.SeedIndex([(1, "x " * 5_000)])
    began = time.perf_counter()
    assert decontam.best_by_item(index, np.ones(200_000, dtype=np.int64)) == {0: (0, 5_000, 5_000)}
    assert time.perf_counter() - began < 20


def test_masked_overlaps_by_brute_force():
    """Every overlap with permitted substitutions is found, and nothing else: against all diagonals of all texts."""
    rng = np.random.default_rng(13)
    items = [rng.integers(1, 40, int(n)) for n in rng.integers(4, 60, 12)]
    index = decontam.SeedIndex([(i, " ".join(f"w{x}" for x in t)) for i, t in enumerate(items)])
    number = index.vocabulary
    for _ in range(60):
        text = rng.integers(1, 40, 120)
        k = int(rng.integers(0, len(items)))
        part = items[k][int(rng.integers(0, max(1, len(items[k]) - 20))) :]
        at = int(rng.integers(0, 120 - len(part)))
        text[at : at + len(part)] = part
        text[rng.integers(at, at + len(part), int(len(part) * rng.random() * 0.3))] = 99
        tokens = np.array([number.get(f"w{x}", 0) for x in text], dtype=np.int64)
        want = {}
        for i, (_, item) in enumerate(index.items):
            found = [(f[2], -d, f) for d in range(-len(item), len(tokens)) if (f := decontam.best_overlap(tokens, item, d))]
            if found:
                want[i] = max(found)[2]
        have = decontam.best_by_item(index, tokens)
        assert have == want
        batch = [tokens[:60], tokens[60:], tokens[:0], tokens]
        assert index.touched(batch) == [i for i, x in enumerate(batch) if index.hits(x)]


def test_one_word_longer_than_an_index(monkeypatch):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.VOCABULARY)
    rng = np.random.default_rng(21)
    word = "".join(rng.choice(list("aeinrst") + ["tion", "é", "中"], 4000))
    monkeypatch.setattr(sentencepieces, "INDEXED_CHARS", 300)
    assert sentencepieces.PieceCoder().encode_batch([word, "a " + word[:700]]) == model.encode([word, "a " + word[:700]])


def test_very_long_texts(spark):
    """Texts of up to 700,000 characters, with and without spaces, with lines and with repeats: each operator gives one result."""
    rng = np.random.default_rng(22)
    many = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 100_000))
    texts = [many, many + " more", "x" * 60_000, "the same line again\n" * 20_000, "mit license " * 20_000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    bench = spark.createDataFrame([(1, " ".join(many.split()[1000:1040])), (2, "the same line again " * 20)], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in decontam.op3_decontamination(docs, bench).collect()}
    assert hits == {(0, 1), (1, 1), (3, 2)}
    assert {r.doc_id: r.n_words for r in quality.op4_quality(docs).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}
    assert sentencepieces.op5_sentencepiece(docs).where("round_trip").count() == len(texts)
    assert linededup.op7_line_dedup(docs).count() == len(texts)
    prints = {r.doc_id: r for r in simhash.op8_simhash(docs).collect()}
    assert prints[0].component_id == prints[1].component_id == 0
    assert {r.id: r.group for r in simhash.near_groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_words for r in tokencount.op9_token_counts(docs).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}
    scan = {r.doc_id: r for r in licenses.op10_license_scan(docs).collect()}
    assert (scan[4].n_base, scan[4].base_labels, scan[0].labels) == (20_000, "mit", "")
    scored = lm.score_documents(docs, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in scored) == sorted(len(t.split()) + 1 for t in texts)
    few = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.op6_toxicity(docs, few).where("score between 0 and 1").count() == len(texts)


def test_pipeline_bears_odd_tables(spark, tmp_path):
    """No rows, no benchmark, no labels, null ids beside null texts, repeated rows, clashing columns."""
    rows = [(1, "one two three four five six seven", "en", "a"), (2, None, None, None), (None, "null id", "en", "b"), (None, None, "en", "b"), (1, "one two three four five six seven", "en", "a"), (3, "", "en", "a")]
    kinds = "doc_id long, text string, lang string, source string"
    clash = {c: F.lit(7) for c in ("shard", "id", "cell", "label", "n", "score", "part", "same", "component", "group", "line", "ids", "fp", "n_chars")}
    write = lambda name, df: df.write.parquet(f"{tmp_path}/{name}.parquet")
    write("benchmark", spark.createDataFrame([], "item_id long, text string"))
    write("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for docs, want in ((spark.createDataFrame(rows, kinds).withColumns(clash), 6), (spark.createDataFrame([], kinds), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() == want
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("round_trip").count() == want


def test_hot_fingerprint_cells(spark):
    """A cell of more than ``cell_rows`` distinct fingerprints is dealt by its other bits, a few rows for each member."""
    rng = np.random.default_rng(23)
    fps = sorted({int(x) << 22 | 5 for x in rng.integers(0, 1 << 41, 3000)} | {(int(x) << 22 | 5) ^ (1 << 60) for x in rng.integers(0, 1 << 41, 10)})
    fps += [f ^ (1 << 30) ^ (1 << 50) for f in fps[:40]]
    df = spark.createDataFrame([(f, f) for f in fps], "id long, fp long")
    cells = simhash.run_cells(df, 2, 64)
    assert cells.count() <= 3 * 3 * len(fps)
    links = simhash.cell_links(cells, 2, 64)
    found = {r.id: r.component for r in simhash.components(links).collect()}
    near = {(a, b) for i, a in enumerate(fps[:3010]) for b in (a ^ (1 << 30) ^ (1 << 50),) if b in set(fps[3010:])}
    assert len(near) == 40 and all(found.get(a, a) == found.get(b, b) for a, b in near)


def test_pivots_link_large_components(spark):
    """Two families and loners in one candidate component, larger than a task may hold."""
    rng = np.random.default_rng(24)
    base = [[f"a{x}" for x in rng.integers(0, 5000, 200)], [f"b{x}" for x in rng.integers(0, 5000, 200)]]
    texts = []
    for i in range(60):
        t = list(base[i % 2]) if i % 10 else [f"c{i}x{x}" for x in rng.integers(0, 5000, 200)]
        t[int(rng.integers(0, 200))] = f"z{i}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long")
    held = simhash.held_links(links, df, 0.8, "doc_id", "text", 1500)
    found = {r.id: r.component for r in simhash.components(held).collect()}
    assert [found.get(i, i) for i in range(60)] == linked(texts)
