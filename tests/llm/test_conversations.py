"""Conversation repair against a plain shortest path over rows and states."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import conversations as cv

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    """Plain rows after damage, and all ids."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def brute_repair(rows):
    """Summary of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: cv.HEAD].encode(), hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(BLANK)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # best[output so far as its last state]: (cost, audit, output)
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(best, state, way):
        if state not in best or way[:2] < best[state][:2]:
            best[state] = way

    def insert(best):
        for _ in range(4):
            for state, (cost, audit, said) in list(best.items()):
                for new in follows[state]:
                    if new != "s":
                        put(best, new, (cost + 5, audit + "I", said + [("user" if new == "u" else "assistant") + ":"]))

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(rows, faults):
        insert(best)
        then = {}
        for state, (cost, audit, said) in best.items():
            put(then, state, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role[:1] and role[:1] in follows[state]:
                put(then, role[:1], (cost + more, audit + "K", said + [f"{role}:{text}"]))
            for new, full in (("u", "user"), ("a", "assistant")):
                if new in follows[state]:
                    put(then, new, (cost + 1 + more, audit + "R", said + [f"{full}:{text}"]))
        best = then
    insert(best)
    cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def brute(rows):
    by = {r[0]: [] for r in rows}
    for conv, *rest in brute_damage(rows):
        by[conv].append(tuple(rest))
    return sorted(((conv, *brute_repair(v)) for conv, v in by.items()), key=str)


def check(df):
    have = sorted((tuple(r) for r in cv.op12_conversation_repair(df).collect()), key=str)
    assert have == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_given_conversations(spark):
    check(spark.read.parquet(f"{SF}/conversations.parquet"))


def random_rows(rnd, convs, longest):
    texts = ["Hi.", "Yes!", "no", "", " \t", "cut of", "ok?", "end.  ", None, "Long enough to be told apart only after forty characters: 1.", "Long enough to be told apart only after forty characters: 2."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux", "s"]
    return [(c, rnd.choice([None, *range(i, i + 3)]), rnd.choice(roles[: rnd.choice((4, 10))]), rnd.choice(texts)) for c in convs for i in range(rnd.randint(1, longest))]


def test_random_conversations(spark):
    rnd = random.Random(3)
    rows = random_rows(rnd, [None, *range(1500)], 14)
    check(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("conv", "a", "b", "kind", "part", "lost", "mark", "head", "place")}))


def test_one_long_conversation_is_cut(spark, monkeypatch):
    monkeypatch.setattr(cv, "CHUNK_ROWS", 300)
    rnd = random.Random(4)
    rows = [(7, i // 2, rnd.choice(("user", "assistant", "assistant", "system")), rnd.choice(("A.", "B", "C!", f"{i}.", f"{i}", ""))) for i in range(6_000)]
    check(spark.createDataFrame(rows + random_rows(rnd, range(6, 12), 5), SCHEMA))
    same = [(1, None, "user", "The same again.")] * 5_000
    check(spark.createDataFrame(same, SCHEMA))


def test_empty_table_and_repaired_rows(spark):
    assert cv.op12_conversation_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Hi."), (1, 4, "user", "More?")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert cv.repair(df).first().audit == "KKDKD"
    whole = cv.repair(df, whole=True).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in whole] == [("K", "system", "Be brief."), ("K", "user", "Hello."), ("K", "assistant", "Hi.")]


@pytest.mark.parametrize("seed", range(8))
def test_grammar_expands_to_its_sequences(seed):
    rnd = random.Random(seed)
    texts = [[rnd.randint(0, 2) for _ in range(rnd.randint(0, 60))] for _ in range(30)] + [[1] * 33, []]
    short, rules = cv.re_pair(texts, 100)
    whole = lambda x: [x] if x < 100 else [z for y in rules[x - 100] for z in whole(y)]
    assert [[z for y in s for z in whole(y)] for s in short] == texts
    pairs = defaultdict(set)
    for k, s in enumerate(short):
        for i, p in enumerate(zip(s, s[1:])):
            pairs[p].add((k, i))
    assert all(len(v) < 3 for v in pairs.values()) and sum(map(len, short)) < sum(map(len, texts)) / 2
