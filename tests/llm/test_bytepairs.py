"""Byte-level BPE against the library that the rank file is for, and against brute-force merging."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from gleaner.llm import bytepairs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bytepairs.rank_file().splitlines())}
    return tiktoken.Encoding("own", pat_str=bytepairs.split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytepairs.RankCoder(bytepairs.rank_file(), bytepairs.split_pattern())


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_documents_and_odd_rows_equal_the_library(spark, library):
    odd = [(1, None), (2, ""), (3, " \t\n\r  "), (4, "<|endoftext|> it's'll \x1c\x85᠎"), (None, "é\x00z 日本 😀"), (4, "again"), (4, "again"), (7, "x" * 30_000), (8, "ab " * 20_000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.withColumns({c: F.lit(1) for c in ("ids", "decoded", "_gl_ids", "n_tokens")})
    have = sorted(bytepairs.op13_byte_bpe(rows).collect(), key=str)
    want = []
    for doc_id, text in docs.collect():
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((text or "").encode())))
    assert [tuple(r) for r in have] == [tuple(r) for r in sorted((type(have[0])(*w) for w in want), key=lambda r: str(type(have[0])(doc_id=r[0], n_tokens=r[1], ids_sha256=r[2], decoded_sha256=r[3])))]
    assert bytepairs.op13_byte_bpe(docs.limit(0)).count() == 0


def test_arrays_and_their_texts(spark, library):
    df = spark.createDataFrame([("a b", 1), (None, 2), ("né", 3)], "text string, ids int")
    out = bytepairs.decode(bytepairs.encode(df)).orderBy("text").collect()
    assert [(r.text, r.ids, bytes(r.decoded)) for r in out] == [(t, library.encode_ordinary(t or ""), (t or "").encode()) for t in (None, "a b", "né")]
    null = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytepairs.decode(null).first().decoded is None


def test_every_kind_of_character_is_split_alike(coder, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xFB00 <= c < 0x20000 or c % 5 == 0)]
    texts = ["a{0}b 1{0}{0} {0}'s".format(chr(c)) for c in points]
    for c, text, ids in zip(points, texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), hex(c)


def test_very_long_pretokens(coder, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdeiou") for _ in range(n)) for n in (63, 64, 65, 5_000, 300_000)] + ["a" * 70_001, " " * 5_000, "é" * 9_999]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert all(len(x) <= bytepairs.LONGEST for x in coder)


def brute(ranks, piece):
    """Lowest rank first, leftmost of equal ones, one merge at a time."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(20))
def test_ranks_in_any_order(seed):
    """Vocabularies whose longer tokens may have lower ranks than what they are made of."""
    rnd = random.Random(seed)
    tokens = {bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))) for _ in range(60)} | {b"a", b"b", b"c"}
    order = rnd.sample(sorted(tokens), len(tokens))
    ranks = {t: i * rnd.randint(1, 30) + i for i, t in enumerate(order)}
    ranks = {t: r for r, t in {r: t for t, r in ranks.items()}.items()}
    for single in (b"a", b"b", b"c"):
        ranks.setdefault(single, max(ranks.values()) + 1)
    coder = bytepairs.RankCoder(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()), r"\S+|\s+")
    pieces = [bytes(rnd.choices(b"abc", k=rnd.randint(1, 40))) for _ in range(60)]
    todo = [p for p in pieces if p not in ranks]
    assert coder.merged(todo) == [brute(ranks, p) for p in todo]
    assert not any(coder.words)
