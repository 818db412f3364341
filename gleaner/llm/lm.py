"""Language-model scoring with a weighted backoff automaton.

States are the root and one state for each history word (or the start of a text) after which some word was
seen ``LEAST`` times or more. A state has an arc for each such word, with its discounted, interpolated
probability, and a failure arc to the root that costs the state's backoff weight; the root has an arc for
every word. One traversal from left to right carries the state over a text and adds up log-probabilities;
the score is exactly that sum, with no cap on states or arcs.

Counting covers all training rows. Texts are dealt into blocks, and in each of two rounds a block tells the parts of
the model what it holds, a part adds up what all blocks tell it, and answers each block with the totals of
that block's own entries, so counting and asking are one exchange. First words, by 64-bit hashes: a part numbers
its words, frequent ones low. Then pairs of numbers, dealt by both words, so that a frequent history meets nowhere;
what the arcs of a state take is added up by history in a third, small exchange. The model stays distributed; each task
has the automaton of its own block only. Numbers are sent in planes of bytes, of which most are zeros, and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, in_small_batches, u64
from .sharding import scattered

#: A word pair seen so often is an arc, whatever the input's size.
LEAST = 2
DISCOUNT = 0.5
#: Added to each count of the root.
ADD = 0.1
BLOCK_BYTES = 4 << 20
PART_BYTES = 12 << 20
#: Stand for a text's end and start: no word holds a space.
END, START = b" end", b" start"


def hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 17)


START_HASH = np.uint64(hashed(START))
NAMES = ("words", "ids", "totals", "u", "w", "counts", "states", "backoffs")
ANSWER = "part long, block long, " + ", ".join(f"{c} binary" for c in NAMES)


class Numbers(dict):
    """Numbers words in the order in which they are met; 0 is the end, 1 the start."""

    def __init__(self):
        super().__init__({END: 0, START: 1})

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """(numbers of each text's tokens, from start to end; the hash of each number's word)."""
    numbers = Numbers()
    get = numbers.__getitem__
    out = [np.array([1, *map(get, t.lower().split()), 0], dtype=np.int64) for t in texts]
    return out, u64([hashed(w) for w in numbers])


def planes(x: np.ndarray) -> bytes:
    """Numbers packed: how many, then all first bytes before all second ones, compressed."""
    raw = x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def size_of(cell: bytes) -> int:
    return int.from_bytes(cell[:8], "little")


def unplaned(cells: list[bytes | None]) -> np.ndarray:
    one = lambda c: np.frombuffer(pa.decompress(c[8:], 8 * size_of(c), codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
    return np.concatenate([np.zeros(0, dtype=np.int64), *(one(c) for c in cells if c and size_of(c))])


def read(cells: list[bytes | None], kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in cells), dtype=kind)


def row(part: int, block: int, **cells: bytes) -> tuple:
    return part, block, *(cells.get(c, b"") for c in NAMES)


def answer_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * len(NAMES))
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["part", "block", *NAMES])


def place(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, -1 if it isn't there."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def runs(part: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    """(an order by part, where each part that occurs is in it)."""
    order = np.lexsort((*then, part))
    own, starts = np.unique(part[order], return_index=True)
    return order, {int(p): slice(a, z) for p, a, z in zip(own, starts, [*starts[1:], len(part)])}


def tell_words(t: pa.Table, n_parts: int) -> pa.Table:
    """The words of one block, with their counts in training rows."""
    texts, hashes = numbered(as_bytes(t["text"].combine_chunks()))
    training = np.repeat(t["training"].to_numpy().astype(np.int64), [len(x) for x in texts])
    counts = np.bincount(np.concatenate(texts), training, len(hashes)).astype(np.int64)
    order, of = runs(hashes % np.uint64(n_parts), hashes)
    hashes, counts, block = hashes[order], counts[order], t["block"][0].as_py()
    return answer_table([row(p, block, words=hashes[x].tobytes(), totals=planes(counts[x])) for p, x in of.items()])


def answer_words(t: pa.Table, n_parts: int) -> pa.Table:
    """Numbers (from 1, 0: no training row holds it) and totals of each block's words, in the order in which it told
    them; with block -1 the part's number of tokens and of words."""
    part, cells = t["part"][0].as_py(), t["words"].to_pylist()
    words, which = np.unique(read(cells), return_inverse=True)
    totals = np.bincount(which, unplaned(t["totals"].to_pylist()), len(words)).astype(np.int64)
    ids = np.empty(len(words), dtype=np.int64)
    ids[np.argsort(-totals, kind="stable")] = np.arange(len(words)) * n_parts + part
    ids = np.where(totals > 0, ids + 1, 0)
    own = words != START_HASH
    rows, a = [row(part, -1, totals=planes(np.array([totals[own].sum(), (totals[own] > 0).sum()])))], 0
    for block, x in zip(t["block"].to_pylist(), cells):
        at = which[a : a + len(x) // 8]
        a += len(at)
        rows.append(row(part, block, ids=planes(ids[at]), totals=planes(totals[at])))
    return answer_table(rows)


def ids_of(hashes: np.ndarray, told: pa.Table, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(number or -1, total) of each word of a block, from the parts' answers to what it has told them."""
    ids, totals = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
    order, of = runs(hashes % np.uint64(n_parts), hashes)
    for part, x, y in zip(*(told[c].to_pylist() for c in ("part", "ids", "totals"))):
        if x:
            at = order[of[part]]
            ids[at], totals[at] = unplaned([x]) - 1, unplaned([y])
    return ids, totals


def pair_parts(u: np.ndarray, w: np.ndarray, n_parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)) % np.uint64(n_parts)


def tell_pairs(t: pa.Table, told: pa.Table, n_parts: int) -> pa.Table:
    """The pairs of known words of one block, with their counts in training rows."""
    if not t.num_rows:
        return answer_table([])
    texts, hashes = numbered(as_bytes(t["text"].combine_chunks()))
    ids, _ = ids_of(hashes, told, n_parts)
    token, training = np.concatenate(texts), np.repeat(t["training"].to_numpy().astype(np.int64), [len(x) for x in texts])
    inner = np.flatnonzero(token != 1)  # tokens that have one before them
    pair, which = np.unique(token[inner - 1] * len(hashes) + token[inner], return_inverse=True)
    counts = np.bincount(which, training[inner], len(pair)).astype(np.int64)
    u, w = ids[pair // len(hashes)], ids[pair % len(hashes)]
    known = (u >= 0) & (w >= 0)
    u, w, counts = u[known], w[known], counts[known]
    order, of = runs(pair_parts(u, w, n_parts), w, u)
    u, w, counts, block = u[order], w[order], counts[order], t["block"][0].as_py()
    return answer_table([row(p, block, u=planes(u[x]), w=planes(w[x]), counts=planes(counts[x])) for p, x in of.items()])


def answer_pairs(t: pa.Table) -> pa.Table:
    """Counts of each block's arcs; with block -2 what the part's arcs take of their histories."""
    part, cells = t["part"][0].as_py(), t["u"].to_pylist()
    u, w = unplaned(cells), unplaned(t["w"].to_pylist())
    order = np.lexsort((w, u))
    first = np.r_[True, (np.diff(u[order]) != 0) | (np.diff(w[order]) != 0)] if len(u) else np.zeros(0, dtype=bool)
    which = np.empty(len(u), dtype=np.int64)
    which[order] = np.cumsum(first) - 1
    counts = np.bincount(which, unplaned(t["counts"].to_pylist()), int(first.sum())).astype(np.int64)
    arcs = counts >= LEAST
    histories, of = np.unique(u[order][first][arcs], return_inverse=True)
    taken = np.bincount(of, counts[arcs] - DISCOUNT, len(histories))
    rows, a = [row(part, -2, states=planes(histories), backoffs=taken.tobytes())], 0
    for block, x in zip(t["block"].to_pylist(), cells):
        at = np.arange(a, a + size_of(x))
        a, at = a + len(at), at[arcs[which[at]]]
        rows.append(row(part, block, u=planes(u[at]), w=planes(w[at]), counts=planes(counts[which[at]])))
    return answer_table(rows)


def left_over(asked: pa.Table, taken: pa.Table) -> pa.Table:
    """Backoff weights of the words that a part has told to each block: what their arcs leave over."""
    states, which = np.unique(unplaned(taken["states"].to_pylist()), return_inverse=True)
    mass = np.bincount(which, read(taken["backoffs"].to_pylist(), np.float64), len(states))
    rows = []
    for part, block, x, y in zip(*(asked[c].to_pylist() for c in ("part", "block", "ids", "totals"))):
        ids = unplaned([x]) - 1
        at = place(states, ids)
        some = (at >= 0) & (ids >= 0)
        rows.append(row(part, block, states=planes(ids[some]), backoffs=(1 - mass[at[some]] / unplaned([y])[some]).tobytes()))
    return answer_table(rows)


def by_history(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Histories and what arcs take of them, sent to the parts that have numbered the histories."""
    for b in batches:
        states, taken = unplaned(b.column("states").to_pylist()), read(b.column("backoffs").to_pylist(), np.float64)
        order, of = runs(states % n_parts)
        states, taken = states[order], taken[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(of), pa.int64()), pa.array([planes(states[s]) for s in of.values()], pa.binary()), pa.array([taken[s].tobytes() for s in of.values()], pa.binary())],
            ["part", "states", "backoffs"],
        )


def train(blocks: DataFrame, n_parts: int) -> tuple[DataFrame, int, int]:
    """(answers to the blocks, number of training tokens, number of distinct ones). ``blocks``: (block, text, training)."""
    told = blocks.groupBy("block").applyInArrow(lambda t: tell_words(t, n_parts), ANSWER)
    words = checkpointed(told.groupBy("part").applyInArrow(lambda t: answer_words(t, n_parts), ANSWER))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [unplaned([c]) for c in b.column("totals").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(sum(c[i] for c in x))]) for i in (0, 1)], ["n", "v"])

    n, v = words.where("block = -1").mapInArrow(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    asked = words.where("block >= 0")
    told = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lambda t, k: tell_pairs(t, k, n_parts), ANSWER)
    pairs = checkpointed(told.groupBy("part").applyInArrow(answer_pairs, ANSWER))
    # arcs are dealt by both words, their histories by themselves
    histories = pairs.where("block = -2").mapInArrow(lambda batches: by_history(batches, n_parts), "part long, states binary, backoffs binary")
    weights = asked.groupBy("part").cogroup(histories.groupBy("part")).applyInArrow(left_over, ANSWER)
    return asked.union(pairs.where("block >= 0")).union(weights), n or 0, v or 0


class Automaton:
    """The automaton of one block's words; a state's number is that of its word, -1 is the root.

    ``arcs[state * width + word]`` is an arc's log10 probability; taking it leads to the word's own state, or
    to the root if it has none. The root's arcs are ``root[word]``.
    """

    def __init__(self, hashes: np.ndarray, told: pa.Table, n_parts: int, n: int, v: int):
        ids, counts = ids_of(hashes, told, n_parts)
        states, at = np.unique(unplaned(told["states"].to_pylist()), return_index=True)
        at_state = np.where(ids >= 0, place(states, ids), -1)
        backoff = np.r_[read(told["backoffs"].to_pylist(), np.float64)[at], 1.0][at_state]
        base = (counts + ADD) / (n + ADD * (v + 1))
        self.width = len(hashes)
        # words of the arcs by their places in the block; each is one of the block's words
        order = np.argsort(ids, kind="stable")
        local = lambda c: order[np.searchsorted(ids[order], unplaned(told[c].to_pylist()))]
        u, w, k = local("u"), local("w"), unplaned(told["counts"].to_pylist())
        # interpolated: an arc holds its discounted share and the root's part of what is left over
        logs = np.log10((k - DISCOUNT) / counts[u] + backoff[u] * base[w])
        self.counts, self.base = counts, np.log10(base)
        self.arcs = dict(zip((u * self.width + w).tolist(), logs.tolist()))
        self.root = self.base.tolist()
        self.fails = np.log10(np.maximum(backoff, 1e-300)).tolist()
        self.state = np.where(at_state >= 0, np.arange(self.width), -1).tolist()

    def traverse(self, tokens: list[int]) -> float:
        """log10 probability of a text's tokens; the first is the start."""
        arcs, root, fails, own, width = self.arcs.get, self.root, self.fails, self.state, self.width
        state, total = own[tokens[0]], 0.0
        for word in tokens[1:]:
            step = arcs(state * width + word) if state >= 0 else root[word]
            if step is None:  # the failure arc, then the root's own
                step = fails[state] + root[word]
            total += step
            state = own[word]
        return total


def score_documents(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``, learned from the
    rows for which ``training`` holds.

    Words are split at ASCII white space, A-Z in lower case, and each text ends with one end token; a
    null text is empty. With no training row at all, N is 0 and every word is unknown. Rows with equal
    ids keep a row each, rows alike in all columns too. Columns besides the two named are not read.
    """
    source = in_small_batches(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    tagged, _, n_blocks = scattered(source, 3, block_bytes)
    docs = tagged.select(F.col("_gl_bucket").alias("block"), "id", "text", "training")
    n_parts = max(8, n_blocks * block_bytes // PART_BYTES)
    answers, n, v = train(docs.select("block", "text", "training"), n_parts)
    kind = source.schema["id"].dataType.simpleString()

    def score(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], f.type) for f in [t.schema.field("id"), *LAST]], ["id", *(f.name for f in LAST)])
        texts, hashes = numbered(as_bytes(t["text"].combine_chunks()))
        automaton, rows = Automaton(hashes, told, n_parts, n, v), []
        for x in texts:
            words = x[1:]
            rows.append((len(words), int((automaton.counts[words] > 0).sum()), n, float(automaton.base[words].sum()), automaton.traverse(x.tolist())))
        return pa.table([t["id"], *(pa.array(c, f.type) for c, f in zip(zip(*rows), LAST))], ["id", *(f.name for f in LAST)])

    schema = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = docs.select("block", "id", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


LAST = [pa.field(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")] + [pa.field(c, pa.float64()) for c in ("base_score", "score")]


def op2_lm_scoring(docs: DataFrame) -> DataFrame:
    """Every row, scored by a model of the rows whose id's CRC has a remainder other than 0; a null id trains and is not held out."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    held_out = F.coalesce(remainder == 0, F.lit(False))
    out = score_documents(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
