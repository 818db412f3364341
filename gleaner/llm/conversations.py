"""Repair of conversations at the least cost, by dynamic programming over a grammar.

A conversation is a sequence of symbols, one for each row's role and fault. A symbol is a min-plus matrix of
transfers between the states of the grammar ``(system? (user assistant)+)?``: what the cheapest edits cost, and
which they are. Re-Pair replaces the most frequent pair of symbols by a rule again and again; a rule's matrix is
the product of its two symbols', made once and shared by all conversations that hold it, and its edits are a rope
of theirs. Of equally cheap edits the ASCII-least are kept; both orders are kept by products, since edits of the
same rows at the same cost are never a prefix of one another.

At scale: faults are found by partial sums and a join of short rows. Symbols are dealt by ranges of conversation
and turn, so a conversation of any size is cut, and its parts' matrices meet later. Only the last step follows a
conversation from end to end, since a hash does: it streams its rows and holds its edits, a byte or so a row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing so far, after system, after user, after assistant. The first and the last may end a conversation.
STATES, ENDS = range(4), (0, 3)
#: Where a kept or new role leads, by its initial and the state before.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BLANK = " \t\n\x0b\x0c\r"
#: Rows of a conversation that make one matrix, and symbols that share a grammar.
CHUNK_ROWS, SHARED_SYMBOLS = 4096, 1 << 16
#: Characters of a text by which rows of one turn and role are sorted, before its digest.
HEAD = 40


def flat(rope) -> str:
    """The letters of a rope: a string, or a pair of ropes."""
    if isinstance(rope, str):
        return rope
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += (x[1], x[0])
    return "".join(out)


def joined(a, b):
    if not a or not b:
        return a or b
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 64 else (a, b)


def better(new, old):
    """The cheaper of two transfers (cost, rope); of equally cheap ones the one whose letters come first."""
    if old is None or new[0] < old[0] or new[0] == old[0] and flat(new[1]) < flat(old[1]):
        return new
    return old


def times(a: list, b: list) -> list:
    """The min-plus product; rows of 4 transfers, None where there is no way. ``a`` may be a single row."""
    out = [None] * len(a)
    for i, one in enumerate(a):
        if one is not None:
            row, y = i - i % 4, i % 4
            for z in STATES:
                two = b[4 * y + z]
                if two is not None:
                    out[row + z] = better((one[0] + two[0], joined(one[1], two[1])), out[row + z])
    return out


def inserting() -> list:
    """Transfers by inserted rows alone."""
    out = [None] * 16
    for x in STATES:
        at, edits = x, ""
        out[4 * x + x] = (0, "")
        for _ in range(2):
            at, edits = 3 if at == 2 else 2, edits + "I"
            out[4 * x + at] = better((INSERT * len(edits), edits), out[4 * x + at])
    return out


CLOSING = inserting()
UNIT = [(0, "") if i % 5 == 0 else None for i in range(16)]


def matrix_of(role: str, fault: str) -> list:
    """Transfers of one row (and rows inserted before it): ``role`` s, u, a or x, ``fault`` b, d, t or -."""
    out = [None] * 16
    for x in STATES:
        out[4 * x + x] = (DELETE, "D")
        if fault in "bd":
            continue
        more = TRUNCATED if fault == "t" else 0
        for new, cost, edit in ((role, KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
            to = STEPS.get((new, x))
            if to is not None:
                out[4 * x + to] = better((cost + more, edit), out[4 * x + to])
    return times(CLOSING, out)


SYMBOLS = list(product("suax", "-tbd"))
NUMBER = {s: k for k, s in enumerate(SYMBOLS)}


def re_pair(sequences: list[list[int]], first_rule: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Sequences in which no pair of symbols stands twice, and the rules: rule k is symbol ``first_rule`` + k."""
    text: list[int] = []
    starts = []
    for s in sequences:
        starts.append(len(text))
        text += [*s, -1]  # no pair reaches over an end
    after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, pair in enumerate(pairwise(text)):
        if -1 not in pair:
            places[pair].add(i)
    queue = [(-len(v), pair) for pair, v in places.items() if len(v) > 1]
    heapify(queue)
    rules = []
    while queue:
        n, pair = heappop(queue)
        if len(places[pair]) != -n:
            if len(places[pair]) > 1:
                heappush(queue, (-len(places[pair]), pair))
            continue
        a, b = pair
        new, changed = first_rule + len(rules), set()
        found = [i for i in sorted(places.pop(pair))]
        taken = 0
        for i in found:
            j = after[i]
            if text[i] != a or text[j] != b:  # it overlapped with the one before
                continue
            p, q = before[i], after[j]
            if p >= 0 and text[p] >= 0:
                places[text[p], a].discard(p)
                places[text[p], new].add(p)
                changed.add((text[p], new))
            if text[q] >= 0:
                places[b, text[q]].discard(j)
                places[new, text[q]].add(i)
                changed.add((new, text[q]))
            text[i], text[j] = new, -2
            after[i], before[q] = q, i
            taken += 1
        if taken:
            rules.append(pair)
        for c in changed:
            if len(places[c]) > 1:
                heappush(queue, (-len(places[c]), c))
    out = []
    for i in starts:
        s = []
        while text[i] != -1:
            s.append(text[i])
            i = after[i]
        out.append(s)
    return out, rules


BASE = [matrix_of(*s) for s in SYMBOLS]


def transfers(sequences: Iterable[tuple[tuple[int, ...], bool]]) -> dict[tuple[tuple[int, ...], bool], list]:
    """For distinct (symbols, whether only the way from the first state matters) their transfers, bottom-up by one grammar."""
    wanted = sorted(set(sequences))
    texts = sorted({s for s, _ in wanted})
    short, rules = re_pair([list(s) for s in texts], len(BASE))
    matrices = BASE.copy()
    for a, b in rules:
        matrices.append(times(matrices[a], matrices[b]))
    by = dict(zip(texts, short))
    out = {}
    for s, alone in wanted:
        m = UNIT[:4] if alone else UNIT
        for symbol in by[s]:
            m = times(m, matrices[symbol])
        out[s, alone] = m
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


PART = (
    "struct<n:long, blank:long, duplicate:long, truncated:long, illegal:long, opens:string, closes:string, turns:long, low:long, high:long,"
    " costs:array<long>, audits:array<string>>"
)
PART_TYPE = pa.struct([
    *((c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal")), ("opens", pa.string()), ("closes", pa.string()),
    *((c, pa.int64()) for c in ("turns", "low", "high")), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
])


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, place: int, alone: bool):
        self.conv, self.place, self.alone = conv, place, alone
        self.symbols: list[int] = []
        self.counts = {"b": 0, "d": 0, "t": 0, "-": 0}
        self.illegal, self.opens, self.closes, self.turns, self.low, self.high = 0, "", "", 0, None, None

    def add(self, turn, role: str, fault: str) -> None:
        self.symbols.append(NUMBER[role, fault])
        self.counts[fault] += 1
        if len(self.symbols) == 1:
            self.opens = role
        else:
            self.illegal += (self.closes, role) not in LEGAL
        self.closes = role
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def row(self, m: list) -> dict:
        return {
            "n": len(self.symbols), "blank": self.counts["b"], "duplicate": self.counts["d"], "truncated": self.counts["t"], "illegal": self.illegal,
            "opens": self.opens, "closes": self.closes, "turns": self.turns, "low": self.low, "high": self.high,
            "costs": [None if x is None else x[0] for x in m], "audits": [None if x is None else flat(x[1]) for x in m],
        }


def chunked(kind: pa.DataType):
    """Sorted rows (conv, turn, role, mark, initial, fault, lost) to rows (conv, a, b, part): a part's transfers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done: list[Chunk] = []
        chunk, last, size, first = None, None, 0, True

        def solved() -> pa.RecordBatch:
            found = transfers((tuple(c.symbols), c.alone) for c in done)
            cells = [c.row(found[tuple(c.symbols), c.alone]) for c in done]
            return pa.RecordBatch.from_arrays(
                [pa.array([c.conv for c in done], kind), pa.array([part] * len(done), pa.int64()), pa.array([c.place for c in done], pa.int64()), pa.array(cells, PART_TYPE)],
                ["conv", "a", "b", "part"],
            )

        for conv, turn, role, mark, initial, fault, lost in rows_of(batches):
            if chunk is None or conv != chunk.conv or len(chunk.symbols) >= CHUNK_ROWS:
                if chunk is not None:
                    done.append(chunk)
                    size += len(chunk.symbols) + 1
                    if size > SHARED_SYMBOLS:
                        yield solved()
                        done, size = [], 0
                new = chunk is None or conv != chunk.conv
                # the first conversation of a partition may have begun in the one before
                chunk = Chunk(conv, 0 if new else chunk.place + 1, new and not first)
                first, last = False, None if new else last
            if lost:
                continue
            now = (turn, role, mark)
            chunk.add(turn, initial, "d" if now == last and fault != "b" else fault)
            last = now
        if chunk is not None:
            done.append(chunk)
            yield solved()

    return run


class Repair:
    """Folds a conversation's parts, and then follows its rows edit by edit."""

    def __init__(self, conv):
        self.conv, self.way, self.counts, self.illegal = conv, UNIT[:4], [0, 0, 0], 0
        self.closes, self.turns, self.low, self.high = "", 0, None, None
        self.audit, self.at, self.state, self.hash, self.fresh = None, 0, 0, hashlib.sha256(), True

    def fold(self, p: dict) -> None:
        m = [None if c is None else (c, e) for c, e in zip(p["costs"], p["audits"])]
        self.way = m if len(m) == 4 else times(self.way, m)
        self.counts = [x + p[c] for x, c in zip(self.counts, ("blank", "duplicate", "truncated"))]
        if p["n"]:
            self.illegal += p["illegal"] + (self.closes != "" and (self.closes, p["opens"]) not in LEGAL)
            self.closes = p["closes"]
        if p["turns"]:
            self.turns += p["turns"] - (self.high == p["low"])
            self.low = p["low"] if self.low is None else self.low
            self.high = p["high"]

    def settle(self) -> None:
        """Choose the edits; called once, after all parts."""
        best = None
        for k, x in enumerate(times(self.way, CLOSING)):
            best = better(x, best) if x is not None and k in ENDS else best
        self.cost, self.audit = best[0], flat(best[1])

    def said(self, role: str, text: str) -> None:
        self.hash.update((("" if self.fresh else "\n") + role + ":" + text).encode())
        self.fresh = False

    def inserted(self) -> list[tuple]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = "assistant" if self.state == 2 else "user"
            self.state, self.at = STEPS[role[0], self.state], self.at + 1
            self.said(role, "")
            out.append(("I", None, role, ""))
        return out

    def row(self, turn, role: str, text: str) -> list[tuple]:
        """(edit, turn, role, text) of one more row and of rows inserted before it; deleted ones are left out."""
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = role if edit == "K" else "assistant" if self.state == 2 else "user"
            self.state = STEPS[role[0], self.state]
            self.said(role, text)
            out.append((edit, turn, role, text))
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts, self.illegal, self.cost, self.audit, self.hash.hexdigest())


def followed(kind: pa.DataType, whole: bool):
    """Sorted rows (conv, a, part, role, text) to summaries, or with ``whole`` to repaired rows."""
    names = ["conv", "place", "edit", "turn", "role", "text"] if whole else ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if whole else [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, place, size = None, [], 0, 0

        def repaired(rows: list[tuple]) -> None:
            nonlocal place, size
            for edit, turn, role, text in rows:
                size += len(text)
                if whole:
                    out.append((now.conv, place, edit, turn, role, text))
                place += 1

        def over() -> None:
            nonlocal size
            if now.audit is None:
                now.settle()
            repaired(now.inserted())
            if not whole:
                out.append(now.summary())
                size += len(now.audit)

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for conv, a, part, role, text in rows_of(batches):
            if now is None or conv != now.conv:
                if now is not None:
                    over()
                now, place = Repair(conv), 0
            if part is not None:
                now.fold(part)
                continue
            if now.audit is None:
                now.settle()
            repaired(now.row(a, role, text))
            if len(out) >= 10_000 or out and size > 1 << 22:
                yield emitted()
                out, size = [], 0
        if now is not None:
            over()
        if out:
            yield emitted()

    return run


def prepared(df: DataFrame, lost: str | None) -> DataFrame:
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return df.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.left(text, F.lit(HEAD)).alias("head"), F.unhex(F.md5(text)).alias("mark"), (F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)).alias("lost"),
    )


def repair(df: DataFrame, lost: str | None = None, whole: bool = False) -> DataFrame:
    """Conversations of ``df`` (conv_id, turn, role, text) repaired at the least cost.

    One row for each conv_id, a null one too: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256; with ``whole`` the repaired rows: conv_id, place, edit (K, R or I), turn, role, text. Rows for which
    the boolean column ``lost`` holds only name their conversation. A null role or text is one space. Rows are taken by
    turn (nulls first), those of one turn by role and text (its first 40 characters, then its MD5); equal rows are
    duplicates of the first. A role that doesn't begin with s, u or a, an empty one too, has no place in the grammar.
    A conversation without rows has zeros and an empty audit; an empty table gives no rows.
    """
    rows = prepared(df, lost)
    seen = F.rtrim("text", F.lit(BLANK))
    slim = rows.select("conv", "turn", "role", "head", "mark", "lost", (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    firsts = slim.where("not lost").groupBy("conv", "role", "mark").agg(F.max(F.col("turn").isNull()).alias("null_turn"), F.min("turn").alias("first_turn"))
    x, y = slim.alias("x"), firsts.alias("y")
    same = F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x.role") == F.col("y.role")) & (F.col("x.mark") == F.col("y.mark"))
    first = F.when(F.col("y.null_turn"), F.col("x.turn").isNull()).otherwise(F.col("x.turn") == F.col("y.first_turn"))
    initial = F.left("x.role", F.lit(1))
    fault = F.when(F.col("x.blank"), "b").when(~first, "d").when(F.col("x.truncated"), "t").otherwise("-")
    symbols = (
        x.join(y, same, "left")
        .select("x.conv", "x.turn", "x.role", "x.head", "x.mark", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"), "x.lost")
        .repartitionByRange("conv", "turn", "role", "head").sortWithinPartitions("conv", "turn", "role", "head", "mark")
        .select("conv", "turn", "role", "mark", "initial", "fault", "lost")
    )
    conv = df.schema["conv_id"].dataType
    kind, name = T.StructType([T.StructField("conv", conv)]), conv.simpleString()
    arrow = to_arrow(kind)
    parts = in_small_batches(symbols).mapInArrow(chunked(arrow), f"conv {name}, a long, b long, part {PART}")
    both = parts.select("conv", F.lit(0).alias("kind"), "a", "b", "part", *(F.lit("").alias(c) for c in ("role", "text", "head")), F.lit(b"").alias("mark")).union(
        rows.where("not lost").select("conv", F.lit(1), "turn", F.lit(0).cast("long"), F.lit(None).cast(PART), "role", "text", "head", "mark")
    )
    both = both.repartition("conv").sortWithinPartitions("conv", "kind", "a", "b", "role", "head", "mark").select("conv", "a", "part", "role", "text")
    shape = "place long, edit string, turn long, role string, text string" if whole else "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return in_small_batches(both).mapInArrow(followed(arrow, whole), f"conv {name}, {shape}").withColumnRenamed("conv", "conv_id")


def to_arrow(kind: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind).field(0).type


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) with faults put in by the checksum of their ids; ``lost`` ones are dropped rows."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(cell("text"), "[.!?]", "")).otherwise(cell("text"))
    times_ = F.explode(F.array_repeat(F.lit(1), F.when(fate == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(cell("role")).alias("role"), text.alias("text"), (fate == 0).alias("lost"), times_.alias("_gl_copy")).drop("_gl_copy")


def op12_conversation_repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``, also where all its rows were dropped: see :func:`repair`."""
    return repair(damaged(conversations), lost="lost")
