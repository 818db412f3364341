"""Byte-level BPE encoding and decoding by a rank queue.

A pre-token is a linked list of byte runs. Every pair of neighbours that the vocabulary can merge waits
in the bucket of its merge rank; which buckets hold anything is kept in a bitmap of two levels, so the
lowest rank is the first set bit of the first word that isn't zero. Merging changes two pairs; their
old entries stay where they are and are skipped when they come up. A pre-token of n bytes takes O(n log n),
whatever its length.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_texts, byte_slices, in_small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a task remembers, and how long (in characters) one may be.
REMEMBERED, LONGEST = 750_000, 64
#: Characters of new pre-tokens that share one queue; a longer pre-token has one of its own.
QUEUED_CHARS = 1 << 17
#: Ranks in a word of the lower level of the bitmap.
WORD_BITS = 8

#: Code points that are letters or numbers only since a version of Unicode later than the one by which the
#: library of the rank files splits (16).
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D
107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686
16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2
1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


def rank_file(name: str = RANKS) -> bytes:
    """The rank file's content, read by the driver; tasks get these bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankCoder(dict):
    """Ids of pre-tokens as packed 32-bit integers, little end first; texts are encoded slice by slice."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        ends = [[f"\\U{x:0>8}" for x in run.split("-")] for run in NEWER.split()]
        self.newer = re.compile("[" + "".join("-".join(e) for e in ends) + "]")
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # ranks of two bytes that stand side by side; -1: they don't merge
        self.pairs = np.full(1 << 16, -1, dtype=np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.words = [0] * ((len(self.tokens) >> WORD_BITS) + 1)

    def split(self, text: str) -> list[str]:
        """Pre-tokens. For the pattern a symbol stands in for each newer letter or number."""
        if self.newer.search(text) is None:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub("\ufffd", text))]

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of some pre-tokens."""
        rest = []
        for piece in pieces:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is None:
                rest.append((piece, data))
            else:
                self[piece] = ids_of([rank])
        if rest:
            for (piece, _), ids in zip(rest, self.merged([data for _, data in rest])):
                self[piece] = ids_of(ids)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of some pre-tokens, which lie end to end in one list and share the queue. Of a pre-token's pairs
        the one of the lowest rank is merged first, the leftmost of equal ones."""
        text, rank_of, words, low = b"".join(pieces), self.ranks.get, self.words, (1 << WORD_BITS) - 1
        n = len(text)
        sizes = np.array([len(x) for x in pieces], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        first = bytearray(n + 1)  # where a pre-token begins
        np.frombuffer(first, dtype=np.uint8)[np.r_[starts, n]] = 1
        # of the run that begins at a place: where the next one does, where the one before does, the rank that its pair waits for
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        laid = np.frombuffer(text, dtype=np.uint8).astype(np.int32)
        ranks = np.r_[self.pairs[laid[:-1] << 8 | laid[1:]], -1]
        ranks[np.frombuffer(first, dtype=np.uint8)[1:] == 1] = -1
        waits = ranks.tolist()
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = np.flatnonzero(np.r_[True, ranks[order][1:] != ranks[order][:-1]]) if len(order) else []
        buckets, top, opened = {}, 0, []
        for a, z in zip(cuts, [*cuts[1:], len(order)]):
            r = int(ranks[order[a]])
            buckets[r] = order[a:z].tolist()
            words[r >> WORD_BITS] |= 1 << (r & low)
            top |= 1 << (r >> WORD_BITS)
        while top:
            w = (top & -top).bit_length() - 1
            r = w << WORD_BITS | (words[w] & -words[w]).bit_length() - 1
            words[w] &= words[w] - 1
            if not words[w]:
                top &= top - 1
            bucket = buckets.pop(r)
            bucket.sort()
            for at, i in enumerate(bucket):
                if waits[i] != r:  # stale: its run has grown or is gone
                    continue
                j = after[i]
                k = after[i] = after[j]
                waits[j] = -1
                p = -1 if first[i] else before[i]
                if first[k]:
                    waits[i] = -1
                else:
                    before[k] = i
                    waits[i] = q = rank_of(text[i : after[k]], -1)
                    if q >= 0:
                        if q in buckets:
                            buckets[q].append(i)
                        else:
                            opened.append(q)
                            buckets[q] = [i]
                if p >= 0:
                    waits[p] = q = rank_of(text[p:k], -1)
                    if q >= 0:
                        if q in buckets:
                            buckets[q].append(p)
                        else:
                            opened.append(q)
                            buckets[q] = [p]
                if opened:
                    for q in opened:
                        words[q >> WORD_BITS] |= 1 << (q & low)
                        top |= 1 << (q >> WORD_BITS)
                    least = min(opened)
                    opened.clear()
                    if least < r and at + 1 < len(bucket):  # a lower rank has come up: what is left of this one waits
                        buckets[r] = bucket[at + 1 :]
                        words[w] |= 1 << (r & low)
                        top |= 1 << w
                        break
        out = []
        for i, size in zip(starts.tolist(), sizes.tolist()):
            end, ids = i + size, []
            while i < end:
                ids.append(self.ranks[text[i : after[i]]])
                i = after[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of some texts."""
        split = [self.split(x) for x in texts]
        if len(self) > REMEMBERED:
            self.clear()
        new, part, size = set(chain.from_iterable(split)).difference(self), [], 0
        for piece in new:
            part.append(piece)
            size += len(piece)
            if size > QUEUED_CHARS:
                self.learn(part)
                part, size = [], 0
        self.learn(part)
        out = [b"".join(map(self.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > LONGEST:
                del self[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids; an id beyond the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def ids_of(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def coder_of(ranks: bytes, pattern: str) -> RankCoder:
    """One coder for each worker process, kept from task to task."""
    state = vars(sys.modules.setdefault("_gleaner_rank_coders", types.ModuleType("_gleaner_rank_coders")))
    key = f"{xxhash.xxh3_64_hexdigest(ranks)} {pattern}"
    if key not in state:
        state[key] = RankCoder(ranks, pattern)
    return state[key]


def encode(
    df: DataFrame, ranks: bytes | None = None, pattern: str | None = None, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None, packed: bool = False
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if not given) and ``out_col``, the ids of the text: an array of integers, or
    with ``packed`` a binary of 32-bit integers, little end first. Null and empty texts have no ids. Special tokens are
    ordinary text. One row for each row; a column named ``out_col`` is replaced. ``ranks`` is a rank file's content."""
    ranks, pattern = rank_file() if ranks is None else ranks, split_pattern() if pattern is None else pattern
    names = [c for c in (df.columns if keep is None else keep) if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out_col, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(*shared.value)
        for whole in batches:
            for b in byte_slices(whole, "_gl_text"):
                ids = coder.encode(as_texts(b.column(len(names))))
                ids = pa.array(ids, pa.binary()) if packed else pa.array([np.frombuffer(x, dtype="<u4") for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], [*names, out_col])

    return in_small_batches(df.select(*names, df[text_col].alias("_gl_text"))).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``, the bytes of its ids (an array, or packed): half a character of UTF-8 may be a token, so only
    whole texts are sure to be text. Null ids give null. A column named ``out_col`` is replaced."""
    ranks = rank_file() if ranks is None else ranks
    names = [c for c in df.columns if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out_col, T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast((ranks, ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(*shared.value)
        at = names.index(ids_col)
        for b in batches:
            packed = [x if x is None or isinstance(x, bytes) else np.array(x, dtype="<u4").tobytes() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else coder.decode(x) for x in packed], pa.binary())], [*names, out_col])

    return in_small_batches(df.select(*names)).mapInArrow(run, schema)


def op13_byte_bpe(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``, repeated ones and null ids too; a null text is an empty one, without tokens."""
    coded = decode(encode(docs.select("doc_id", "text"), keep=["doc_id"], packed=True))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
