"""Benchmark decontamination by spaced seeds.

A mask is a fixed pattern of token positions that count; the others are ignored, so a substituted
token under an ignored position leaves the hash as it is. Hashes of all masked windows of the
benchmark are joined with those of every text; around each hit the passage is compared token by
token along the hit's diagonal, and an overlap holds if enough of it matches.

At scale: documents are scanned once and never shuffled. The benchmark goes to the tasks in blocks
of at most ``BLOCK_BYTES`` (its size is measured first); a larger benchmark takes several passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, byte_slices, checkpointed, in_small_batches, sent, sent_whole, u64

#: 1: the token counts, 0: it may differ. One of them fits into every overlap of 10 to 23 tokens with the
#: permitted substitutions, and so into longer ones: of pieces that long, one has no larger share of them.
MASKS = ("1111011", "1110100011", "10011111", "1101000111", "11101101", "111111")
#: Items shorter than this are sought whole, by masks of their own length.
SHORT = 10
#: An overlap holds from this many tokens on (or the whole item if it is shorter) ...
MIN_TOKENS = 12
#: ... with at most this share of substituted tokens.
MAX_SUBSTITUTED = 0.2
BLOCK_BYTES = 8 << 20
TOKEN = re.compile(r"[^\W_]+")
PRIME = 0x9E3779B97F4A7C15


def whole_masks(n: int) -> list[str]:
    """Masks of a whole item: one for each permitted set of substituted tokens between its ends."""
    sets = combinations(range(1, n - 1), int(n * MAX_SUBSTITUTED + 1e-9))
    return ["".join("0" if i in out else "1" for i in range(n)) for out in sets]


class Numbers(dict):
    """Numbers of tokens; a token of no item is 0."""

    def __missing__(self, token: str) -> int:
        return 0


class SeedIndex:
    """Masked windows of some benchmark items: tokens as small numbers; for each mask a sorted array of hashes
    and, in the same order, where in which item each window begins."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item, text in items:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in TOKEN.findall((text or "").lower())]
            if tokens:
                self.items.append((item, np.array(tokens, dtype=np.int64)))
        sizes = np.array([len(t) for _, t in self.items], dtype=np.int64)
        laid, begins = np.concatenate([u64([]).astype(np.int64), *(t for _, t in self.items)]), np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(laid)) - begins[owner] if len(laid) else laid
        short = sorted({len(t) for _, t in self.items if len(t) < SHORT})
        masks = [*((m, False) for m in MASKS), *((m, True) for n in short for m in whole_masks(n))]
        self.seeds = []
        for mask, own in masks:
            at = np.flatnonzero(np.frombuffer(mask.encode(), dtype=np.uint8) == ord("1"))
            where = np.flatnonzero(sizes[owner] == len(mask) if own else inside + len(mask) <= sizes[owner])
            where = where[inside[where] == 0] if own else where
            h = masked_hashes(laid, at, where)
            order = np.argsort(h, kind="stable")
            where = where[order]
            self.seeds.append((len(mask), at, h[order], owner[where].astype(np.int32), inside[where].astype(np.int32)))
        # for each mask which low bits its hashes have: nearly all windows of a text are told apart by them
        self.bits = []
        for _, _, hashes, *_ in self.seeds:
            bits = np.zeros(1 << min(24, (16 * len(hashes) + 1).bit_length()), dtype=bool)
            bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.bits.append(bits)

    def touched(self, texts: list[np.ndarray]) -> list[int]:
        """Which of some texts (arrays of tokens) have a masked match at all; they are looked through end to end."""
        gap = np.zeros(max((s[0] for s in self.seeds), default=0), dtype=np.int64)  # no mask reaches over it
        laid = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
        begins = len(gap) + np.cumsum([0, *(len(t) + len(gap) for t in texts)])[:-1]
        known, hit = laid > 0, np.zeros(len(texts), dtype=bool)
        for (span, at, hashes, *_), bits in zip(self.seeds, self.bits):
            n = len(laid) - span + 1
            if n <= 0 or not len(hashes):
                continue
            ok = known[at[0] : at[0] + n].copy()
            for o in at[1:]:
                ok &= known[o : o + n]
            where = np.flatnonzero(ok)
            h = masked_hashes(laid, at, where)
            some = bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)]
            where, h = where[some], h[some]
            found = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
            hit[np.searchsorted(begins, where[found], "right") - 1] = True
        return np.flatnonzero(hit).tolist()

    def hits(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(item index, diagonal) of every masked match in an array of tokens; 0 is a token of no item.

        Matches of one hash are taken together: its places in the text and in an item give all their
        differences, which for many places on both sides are found by a convolution.
        """
        known, found = tokens > 0, set()
        for span, at, hashes, owner, inside in self.seeds:
            n = len(tokens) - span + 1
            if n <= 0 or not len(hashes):
                continue
            ok = known[at[0] : at[0] + n].copy()
            for o in at[1:]:
                ok &= known[o : o + n]
            where = np.flatnonzero(ok)
            h = masked_hashes(tokens, at, where)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = high > low
            where, low, high = where[some], low[some], high[some]
            order = np.argsort(low, kind="stable")
            where, low, high = where[order], low[order], high[order]
            cuts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else []
            for a, z in zip(cuts, [*cuts[1:], len(low)]):
                spots, items, places = where[a:z], owner[low[a] : high[a]], inside[low[a] : high[a]]
                for k in np.unique(items).tolist():
                    found.update((k, int(d)) for d in differences(spots, places[items == k].astype(np.int64)))
        return sorted(found)


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct x[i] - y[j]."""
    if len(x) * len(y) <= 1 << 16:
        return np.unique(x[:, None] - y[None, :])
    # where the two sets of places overlap when one is moved along the other: counts of a convolution
    a, b = np.zeros(int(x.max() - x.min()) + 1), np.zeros(int(y.max() - y.min()) + 1)
    a[x - x.min()], b[y.max() - y] = 1, 1
    size = 1 << (len(a) + len(b) - 1).bit_length()
    times = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: len(a) + len(b) - 1]
    return np.flatnonzero(times > 0.5) + int(x.min() - y.max())


def best_by_item(index: SeedIndex, tokens: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """(start, end, matching tokens) for each item that overlaps: most matching tokens, then the smallest diagonal.

    Diagonals that have room for fewer tokens than have matched already are not looked at.
    """
    best: dict[int, tuple] = {}
    room = lambda k, d: min(len(tokens), d + len(index.items[k][1])) - max(0, d)
    for negative, k, d in sorted((-room(k, d), k, d) for k, d in index.hits(tokens)):
        have = best.get(k)
        if have and (have[0] > -negative or have[0] == -negative and have[1] < d):
            continue
        found = best_overlap(tokens, index.items[k][1], d)
        if found and (have is None or (found[2], -d) > (have[0], -have[1])):
            best[k] = (found[2], d, found)
    return {k: best[k][2] for k in sorted(best)}


def masked_hashes(tokens: np.ndarray, at: np.ndarray, where: np.ndarray) -> np.ndarray:
    h = np.zeros(len(where), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for o in at:
            h = (h ^ tokens[where + o].astype(np.uint64)) * np.uint64(PRIME)
            h ^= h >> np.uint64(29)
    return h


def best_overlap(tokens: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start, end, matching tokens) of the longest overlap on a diagonal that holds, or None.

    Start and end are token positions of the text; the ends of an overlap match.
    """
    low, high = max(0, diagonal), min(len(tokens), diagonal + len(item))
    same = (tokens[low:high] == item[low - diagonal : high - diagonal]).astype(np.int64)
    least = min(MIN_TOKENS, len(item))
    if len(same) < least or not same.any():
        return None
    # matches minus their least share, summed: an interval holds if its sum isn't negative
    gain = np.r_[0, np.cumsum(same - (1 - MAX_SUBSTITUTED))] + 1e-9 * np.arange(len(same) + 1)
    starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    lowest = np.minimum.accumulate(gain[starts])
    best = None
    for e in ends[::-1]:
        s = int(starts[np.searchsorted(-lowest, -gain[e], "left")]) if gain[e] >= lowest[-1] else e
        if e - s >= least and (best is None or e - s > best[1] - best[0]):
            best = (s, int(e))
        if best and e <= best[1] - best[0]:
            break
    return None if best is None else (low + best[0], low + best[1], int(same[best[0] : best[1]].sum()))


def contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row for each document and benchmark item that overlap: (id, item_id, first_token, end_token,
    n_matched, n_item), the longest overlap of the two.

    Tokens are runs of letters and digits in lower case. Null texts and wordless items overlap with
    nothing; repeated rows are reported each; empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("t")).where("t <> ''")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, first_token long, end_token long, n_matched long, n_item long"
    source = in_small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    passes = []
    for block in range(n_blocks):
        mine = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n_blocks)) == block)
        index = sent(df.sparkSession, SeedIndex([tuple(r) for r in mine.orderBy("item_id", "t").collect()]))
        passes.append(source.mapInArrow(scanner(index, source.schema["id"].dataType), schema))
    out = reduce(DataFrame.unionByName, passes)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def scanner(index, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: SeedIndex = index()
        number = Numbers(seeds.vocabulary).__getitem__
        for whole in batches:
            for b in byte_slices(whole, "text"):
                texts = [np.array(list(map(number, TOKEN.findall(text.lower()))), dtype=np.int64) for text in as_texts(b.column(1))]
                rows = [(k, seeds.items[i][0], *x, len(seeds.items[i][1])) for k in seeds.touched(texts) for i, x in best_by_item(seeds, texts[k]).items()]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    ["id", "item_id", "first_token", "end_token", "n_matched", "n_item"],
                )

    return run


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose text overlaps with no benchmark item. Rows of one id are told apart by their texts; rows with a null id stay."""
    own = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")).alias("_gl_row"), F.col(text_col).alias("text"))
    found = checkpointed(contaminated(own, benchmark, "_gl_row", "text").select(F.col("_gl_row.id").alias("_gl_id"), F.col("_gl_row.mark").alias("_gl_mark")).distinct())
    return df.join(sent_whole(found), (df[id_col] == F.col("_gl_id")) & (F.xxhash64(df[text_col]) == F.col("_gl_mark")), "left_anti")


def op3_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The overlaps of all documents; a null text or item overlaps with nothing."""
    return contaminated(docs, benchmark)
