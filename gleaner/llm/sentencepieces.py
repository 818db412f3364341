"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and indexed by a suffix array; a binary search of
every vocabulary piece gives the range of suffixes that begin with it, that is, all its occurrences.
Those are edges between positions; sorted by position they are relaxed from left to right: a position
keeps the one last piece with which the best merges reach it. Which piece follows which is settled by
the rule of merge tokenizers that a sequence is the encoding of its text exactly if each two
neighbours are the encoding of theirs.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_texts, byte_slices, in_small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose encodings a task remembers.
REMEMBERED = 150_000
SEGMENT = re.compile(MARK + "*[^" + MARK + "]+|" + MARK + "+")
#: Pairs of pieces that a task remembers.
PAIRS = 350_000
#: Characters that one suffix array indexes.
INDEXED_CHARS = 1 << 17


def model_file(path: str) -> bytes:
    """The vocabulary's content, read by the driver; tasks get these bytes."""
    with open(path, "rb") as f:
        return f.read()


class PieceCoder:
    def __init__(self, path: str = VOCABULARY, model: bytes | None = None):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model_file(path) if model is None else model)
        size = m.get_piece_size()
        self.byte_ids = {}
        self.piece_bytes: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(size):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.piece_bytes.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.piece_bytes.append(b"")
            else:
                self.ids[p], self.score[p] = i, m.get_score(i)
                self.piece_bytes.append(p.replace(MARK, " ").encode())
        if any(re.search("[^" + MARK + "]" + MARK, p) for p in self.ids):
            raise ValueError("a piece goes on over a word's end; words can't be coded one by one")
        self.known: dict[str, tuple[int, ...]] = {}
        alphabet = sorted({c for p in self.ids for c in p})
        #: A character as a number: 1 between words, 2 and up for the pieces' characters, 65534 for others.
        self.rank = np.full(0x110000, 65534, dtype=np.uint16)
        self.rank[[ord(c) for c in alphabet]] = np.arange(len(alphabet)) + 2
        self.rank[10] = 1
        whole = [p for p in self.ids if "\n" not in p and self.merged(p) == [p]]  # others are never an encoding's part
        self.width = 1 << (max(map(len, whole)) - 1).bit_length()
        self.keys = self.coded(whole, b"")
        self.tops = self.coded(whole, b"\xff\xff")
        self.pieces = whole
        self.lengths = np.array([len(p) for p in whole])
        self.piece_ids = np.array([self.ids[p] for p in whole], dtype=np.int64)
        self.settled: dict[int, bool] = {}
        self.slot_keys, self.slot_holds = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)

    def coded(self, pieces: list[str], end: bytes) -> np.ndarray:
        """Fixed-width search keys; big-endian, so that they sort as their character numbers do."""
        out = [self.rank[np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)].astype(">u2").tobytes() + end for p in pieces]
        return np.array(out, dtype=f"S{2 * self.width + 2}")

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for short strings: join the best-scored neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces ``b`` can stand after the pieces ``a``: each pair is settled once."""
        n, p = len(self.pieces), self.pieces
        keys = a * n + b
        slots = (keys * 0x9E3779B1 >> 13) & (len(self.slot_keys) - 1)
        miss = np.flatnonzero(self.slot_keys[slots] != keys)
        if not len(miss):
            return self.slot_holds[slots]
        holds = self.slot_holds[slots]
        for i, k in zip(miss.tolist(), keys[miss].tolist()):
            ok = self.settled.get(k)
            if ok is None:
                x, y = p[k // n], p[k % n]
                ok = self.settled[k] = self.merged(x + y) == [x, y]
            holds[i] = ok
        self.slot_keys[slots[miss]] = keys[miss]
        # two keys of one slot: the slot holds the last written key, so its answer is written alike
        self.slot_holds[slots[miss]] = holds[miss]
        return holds

    def suffix_array(self, codes: np.ndarray) -> np.ndarray:
        """Starts of all suffixes in the order of their first ``width`` characters, by prefix doubling."""
        c = np.concatenate([codes, np.zeros(self.width, dtype=np.uint16)]).astype(np.uint64)
        n, have = len(codes), 4
        key = c[:n] << np.uint64(48) | c[1 : n + 1] << np.uint64(32) | c[2 : n + 2] << np.uint64(16) | c[3 : n + 3]
        while True:
            order = np.argsort(key)
            if have >= self.width:
                return order
            ranked = key[order]
            rank = np.empty(n + self.width, dtype=np.uint64)
            rank[n:] = 0
            rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
            key = rank[:n] << np.uint64(32) | rank[have : n + have]
            have *= 2

    def edges(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of a piece that begins in the first ``n`` characters: the pieces'
        ranges in the suffix array. A longer text (one word without an end) is indexed run by run."""
        array = self.suffix_array(codes)
        padded = np.concatenate([codes, np.zeros(self.width, dtype=np.uint16)]).astype(">u2")
        keys = np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(codes)][array]
        ordered = np.ascontiguousarray(keys).view(f"S{2 * self.width}").reshape(-1)
        low, high = np.searchsorted(ordered, self.keys, "left"), np.searchsorted(ordered, self.tops, "left")
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        runs = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts, which = array[np.repeat(low[found], counts) + runs], np.repeat(found, counts)
        return starts[starts < n], which[starts < n]

    def learn(self, words: list[str]) -> None:
        """Encode new words through a suffix array over all of them."""
        text = "\n".join(words) + "\n"
        codes = self.rank[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        n = len(codes)
        found = [self.edges(codes[i : i + INDEXED_CHARS + self.width], min(INDEXED_CHARS, n - i)) for i in range(0, n, INDEXED_CHARS)]
        starts = np.concatenate([x + i * INDEXED_CHARS for i, (x, _) in enumerate(found)])
        which = np.concatenate([x for _, x in found])
        # edges by their place in the word, then by position
        sizes = np.array([len(w) for w in words])
        begins = np.cumsum(sizes + 1) - sizes - 1
        inside = np.arange(n) - np.repeat(begins, sizes + 1)
        starts_in = inside[starts]
        order = np.argsort(starts_in.astype(np.uint16) if sizes.max() < 1 << 16 else starts_in, kind="stable")
        starts, which, starts_in = starts[order], which[order], starts_in[order]
        ends = starts + self.lengths[which]
        # last[i]: the last piece of the best way to position i; -1 not reached, -2 none or a bare character
        last, came = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
        last[begins] = -2
        bare = np.flatnonzero(codes == 65534)
        bare = bare[np.argsort(inside[bare], kind="stable")]
        top = int(sizes.max())
        cut, cut_bare = np.searchsorted(starts_in, np.arange(top + 1)), np.searchsorted(inside[bare], np.arange(top + 1))
        for k in range(top):
            i, j, p = (x[cut[k] : cut[k + 1]] for x in (starts, ends, which))
            ok = (last[i] != -1) & (last[j] == -1)
            i, j, p = i[ok], j[ok], p[ok]
            after = last[i] >= 0
            good = ~after
            if after.any():
                good[after] = self.follow(last[i[after]], p[after])
            last[j[good]], came[j[good]] = p[good], i[good]
            if cut_bare[k] < cut_bare[k + 1]:
                i = bare[cut_bare[k] : cut_bare[k + 1]]
                last[i + 1], came[i + 1] = -2, i
        # back from each word's end
        at, word, out, taken = begins + sizes, np.arange(len(words)), [], np.zeros(len(words), dtype=np.int64)
        while len(at):
            out.append((word, taken[word], last[at], at))
            taken[word] += 1
            at = came[at]
            on = at > begins[word]
            at, word = at[on], word[on]
        word, step, piece, at = (np.concatenate(x) for x in zip(*out))
        cuts = np.r_[0, np.cumsum(taken)]
        place = cuts[word + 1] - 1 - step
        ids, spot = np.empty(len(word), dtype=np.int64), np.empty(len(word), dtype=np.int64)
        ids[place], spot[place] = np.where(piece >= 0, self.piece_ids[piece], -1), at
        ids, cuts = ids.tolist(), cuts.tolist()
        whole = np.ones(len(words), dtype=bool)
        whole[word[piece < 0]] = False
        for w, a, z, fine in zip(words, cuts, cuts[1:], whole.tolist()):
            if fine:
                self.known[w] = tuple(ids[a:z])
            else:  # a character in no piece becomes its bytes
                bytes_at = lambda k: [self.byte_ids[x] for x in text[spot[k] - 1].encode()]
                self.known[w] = tuple(x for k in range(a, z) for x in (bytes_at(k) if ids[k] < 0 else (ids[k],)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if len(self.settled) > PAIRS:
            self.settled.clear()
        split = [SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new, size = {}, 0
        for words in split:
            for w in words:
                if w not in self.known and w not in new:
                    new[w] = True
                    size += len(w)
                    if size > INDEXED_CHARS:
                        self.take(new)
                        new, size = {}, 0
        self.take(new)
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]

    def take(self, words: dict[str, bool]) -> None:
        """A line end divides words in the index, so a word that holds one is coded around it."""
        plain = [w for w in words if "\n" not in w]
        odd = [w for w in words if "\n" in w]
        parts = {p for w in odd for p in w.split("\n") if p}
        plain += [p for p in parts if p not in self.known and p not in words]
        if plain:
            self.learn(plain)
        line = tuple([self.ids["\n"]] if "\n" in self.ids else [self.byte_ids[10]])
        for w in odd:
            out: tuple[int, ...] = ()
            for k, p in enumerate(w.split("\n")):
                out += (line if k else ()) + (self.known[p] if p else ())
            self.known[w] = out

    def decode(self, ids: list[int]) -> str:
        """The text again: pieces and bytes joined, without the space that encoding puts first."""
        text = b"".join(map(self.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def coder_of(model: bytes) -> PieceCoder:
    """One coder for each worker process, kept from task to task."""
    state = vars(sys.modules.setdefault("_gleaner_coders", types.ModuleType("_gleaner_coders")))
    key = xxhash.xxh3_64_hexdigest(model)
    if key not in state:
        state[key] = PieceCoder(model=model)
    return state[key]


def encode(df: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """``df`` with ``out_col``: struct(ids array<int>, exact boolean). ``exact``: decoding the ids gives
    the text. Null and empty texts have no ids and are exact. A column named ``out_col`` is replaced."""
    names = [c for c in df.columns if c != out_col]
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out_col, kind)])
    shared = df.sparkSession.sparkContext.broadcast(model_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        at = names.index(text_col)
        for whole in batches:
            for b in byte_slices(whole, text_col):
                texts = as_texts(b.column(at))
                coded = coder.encode_batch(texts)
                exact = [coder.decode(ids) == t for ids, t in zip(coded, texts)]
                pieces = pa.StructArray.from_arrays([pa.array(coded, pa.list_(pa.int32())), pa.array(exact)], ["ids", "exact"])
                yield pa.RecordBatch.from_arrays([*b.columns, pieces], [*names, out_col])

    return in_small_batches(df.select(*names)).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY, out_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids; null ids give a null text."""
    names = [c for c in df.columns if c != out_col]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out_col, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(model_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for b in batches:
            texts = [None if x is None else coder.decode(x) for x in b.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out_col])

    return in_small_batches(df.select(*names)).mapInArrow(run, schema)


def op5_sentencepiece(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; a null text is an empty one: no tokens, and a round trip."""
    return encode(docs.select("doc_id", "text")).select(
        "doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"), F.xxhash64("pieces.ids").alias("ids_hash"),
        F.col("pieces.exact").alias("round_trip"),
    )
