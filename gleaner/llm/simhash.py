"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64-bit votes of hashed shingles. A pair within ``budget`` differing bits agrees
wholly on one of ``budget + 1`` runs of bits, so each fingerprint is dealt once for each run, by the
run's value. Inside such a cell the sorted fingerprints are a binary trie: pairs of nodes go down
together, add up differing bits and stop as soon as the budget is exceeded. Of the pairs found only
a spanning forest leaves the task, never all pairs of a group; components are then joined by
alternating star steps whose state is checkpointed.

A cell with more than ``cell_rows`` members is dealt once more by runs of its other bits; what is still as large is
cut into chunks by hash, and every pair of chunks is a cell of its own, so that no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, byte_slices, checkpointed, in_small_batches, sent_whole, signed, u64

SEED = 42
CELL_ROWS = 2048
ONE = np.uint64(1)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each ``k``-word shingle of a text, repeats included; fewer words: of the whole sequence."""
    words = text.lower().split()
    h, seed = xxhash.xxh64_intdigest, SEED
    if k == 1:
        return u64([h(w, seed) for w in words])
    if len(words) <= k:
        return u64([h(b" ".join(words), seed)] if words else [])
    if k == 3:
        return u64([h(b"%b %b %b" % x, seed) for x in zip(words, words[1:], words[2:])])
    return u64([h(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(k)))])


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash; salt 0 leaves them."""
    if not salt:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    n, votes = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every text; a null or wordless text has fingerprint 0."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                fp = u64([fingerprint(shingle_hashes(t, k)) for t in as_bytes(b.column("text"))])
                yield pa.RecordBatch.from_arrays([b.column(0), signed(fp)], ["id", "fp"])

    return in_small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, fp long")


def runs_of_bits(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of budget+1 runs that cover the lowest ``bits``."""
    cuts = [bits * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Forest:
    """Union-find over 0..n-1 that keeps the joins made."""

    def __init__(self, n: int):
        self.root, self.joins = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the ends of links that are not together yet."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            high, at = np.unique(high, return_index=True)  # each root hangs under one other root
            self.root[high] = low[at]
            self.joins.append(np.stack([high, low[at]]))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up

    def links(self) -> np.ndarray:
        return np.concatenate(self.joins, axis=1) if self.joins else np.empty((2, 0), dtype=np.int64)


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits inside each run [start, end) of ``values``, sorted inside the run.

    The run's values are the leaves of a binary trie; a node is a range of leaves. A pair of nodes
    goes down one bit at a time until it covers few leaf pairs, which are compared at once.
    """
    ones = np.zeros((65, len(values) + 1), dtype=np.int32)
    for bit in range(64):
        np.cumsum((values >> np.uint64(63 - bit)) & ONE, out=ones[bit, 1:])
    zero = np.zeros(len(starts), dtype=np.int64)
    stack = [(0, np.asarray(starts), np.asarray(ends), np.asarray(starts), np.asarray(ends), zero)]
    while stack:
        bit, a, az, b, bz, d = stack.pop()
        if len(a) > most:  # keep the work list short: one part first, the rest later
            stack += [(bit, *(x[i : i + most // 2] for x in (a, az, b, bz, d))) for i in range(0, len(a), most // 2)]
            continue
        own = a == b
        cells = (az - a) * (bz - b)
        small = (cells <= 64) | (bit == 64)
        for i in np.flatnonzero(small & (cells > 1 << 16)):  # equal values in great number: row by row
            for x in range(a[i], az[i]):
                y = np.arange(x + 1 if own[i] else b[i], bz[i])
                yield np.full(len(y), x), y
        few = np.flatnonzero(small & (cells > own) & (cells <= 1 << 16))
        while len(few):
            many = max(1, int(np.searchsorted(np.cumsum(cells[few]), 1 << 19, side="right")))
            part, few = few[:many], few[many:]
            c, wide = cells[part], (bz - b)[part]
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            x = np.repeat(a[part], c) + at // np.repeat(wide, c)
            y = np.repeat(b[part], c) + at % np.repeat(wide, c)
            near = (np.bitwise_count(values[x] ^ values[y]) <= budget) & ((x < y) | ~np.repeat(own[part], c))
            yield x[near], y[near]
        go = np.flatnonzero(~small)
        if not len(go):
            continue
        a, az, b, bz, d, own = a[go], az[go], b[go], bz[go], d[go], own[go]
        am = az - (ones[bit][az] - ones[bit][a])
        bm = bz - (ones[bit][bz] - ones[bit][b])
        nxt = []
        for lo, hi, lo2, hi2, more, keep in (
            (a, am, b, bm, 0, None), (am, az, bm, bz, 0, None), (a, am, bm, bz, 1, None), (am, az, b, bm, 1, ~own),
        ):
            ok = (lo < hi) & (lo2 < hi2) & (d + more <= budget)
            ok = ok if keep is None else ok & keep
            nxt.append((lo[ok], hi[ok], lo2[ok], hi2[ok], d[ok] + more))
        stack.append((bit + 1, *(np.concatenate(x) for x in zip(*nxt))))


def by_cell(batches: Iterator[pa.RecordBatch], joined: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``joined`` of runs of whole cells, from batches in the order of their ``cell``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        cell = t["cell"].to_numpy()
        cut = int(np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])[-1])  # the last cell may go on
        if cut:
            yield joined(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
    if held:
        yield joined(pa.Table.from_batches(held).combine_chunks())


def cell_links(rows: DataFrame, budget: int, cell_rows: int | None = CELL_ROWS) -> DataFrame:
    """Links (a, b) that join what is within ``budget`` bits: a spanning forest of each cell.

    ``rows``: (cell long, id long, fp long). Cells of more than ``cell_rows`` rows are cut into chunks, and each pair
    of chunks is a cell; None: no cell is so large.
    """
    if cell_rows:
        sized = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
        chunks = F.coalesce(F.ceil(F.col("n") / cell_rows), F.lit(1)).cast("int")
        mine = F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")).cast("int")
        rows = (
            rows.join(sized, "cell", "left").withColumn("chunks", chunks).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("cell", F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
            .select(*rows.columns)
        )
    parted = rows.repartition("cell").sortWithinPartitions("cell", "fp", "id")

    def joined(t: pa.Table) -> pa.RecordBatch:
        cell, ids = t["cell"].to_numpy(), t["id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[starts[1:], len(cell)]
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        values = t["fp"].to_numpy().view(np.uint64).copy()
        # signed order in the cells: sort each run anew as unsigned
        order = np.lexsort((values, cell))
        values, ids = values[order], ids[order]
        forest = Forest(len(ids))
        for x, y in trie_pairs(values, starts, ends, budget):
            forest.add(x, y)
        a, b = forest.links()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    return parted.mapInArrow(lambda batches: by_cell(batches, joined), "a long, b long").where("a <> b").distinct()


def run_cells(prints: DataFrame, budget: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(cell, id, fp) of distinct fingerprints (id, fp): a cell for each run of bits and its value.

    Members of a cell differ in the other bits only, so a cell of more than ``cell_rows`` members is dealt once more,
    by runs of those: ``budget + 1`` rows for each of its members, however many there are.
    """
    rest = lambda s, w: F.shiftrightunsigned("fp", s + w).bitwiseOR(F.shiftleft("fp", 64 - s - w)) if s + w < 64 else F.col("fp")
    key = lambda i, x, s, w: F.xxhash64(F.lit(i), F.shiftrightunsigned(x, s).bitwiseAND((1 << w) - 1))
    first = F.array(*(F.struct(key(i, "fp", s, w).alias("cell"), rest(s, w).alias("rest"), F.lit(64 - w).alias("bits")) for i, (s, w) in enumerate(runs_of_bits(budget))))
    rows = checkpointed(prints.select("id", "fp", F.inline(first)))
    large = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select("cell", F.lit(True).alias("large"))
    cut = lambda bits: F.array(*(key(i, "rest", s, w) for i, (s, w) in enumerate(runs_of_bits(budget, bits))))
    finer = F.transform(F.when(F.col("bits") == 64 - 64 // (budget + 1), cut(64 - 64 // (budget + 1))).otherwise(cut(63 - 64 // (budget + 1))), lambda c: F.xxhash64("cell", c))
    return rows.join(sent_whole(checkpointed(large)), "cell", "left").select(F.explode(F.when(F.col("large"), finer).otherwise(F.array("cell"))).alias("cell"), "id", "fp")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach. Ids without a link are not in the result.

    Alternating large-star and small-star steps; each round is checkpointed, and rounds end when the
    links no longer change.
    """
    now = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = checkpointed(small.select("v", "m").where("v > m").union(low.select("u", "m")).toDF("u", "v").distinct())
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def simhash_components(df: DataFrame, k: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: fingerprints link at ``budget`` or fewer differing bits.

    Rows with one fingerprint are one class: only distinct fingerprints are joined, so copies cost
    nothing more. A null text is an empty one; repeated ids keep a row each; an empty table gives none.
    """
    prints = checkpointed(fingerprints(df, k, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    rows = run_cells(distinct.select(F.col("fp").alias("id"), "fp"), budget)
    found = components(cell_links(rows, budget)).select(F.col("id").alias("fp"), "component")
    named = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


def op8_simhash(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; null and wordless texts have fingerprint zero and are one component."""
    out = simhash_components(docs)
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies by five-word shingles ------------------------------------------------------

#: Bands of smallest hashes. A pair of similarity s agrees wholly on one of them with a chance of
#: 1 - (1 - s^BAND_HASHES)^BANDS: 0.9998 at 0.8, whatever the kind of edit.
BANDS = 16
BAND_HASHES = 4
SHINGLE = 5
SIMILARITY = 0.8
#: Standard deviations of a fingerprint's error that the trie's budget allows for.
DOUBT = 4
#: Shingles of a component that are counted in one task.
CELL_SHINGLES = 1 << 20
#: Members of larger components are compared with so many chosen ones before the rest is compared with all.
PIVOTS = 3
#: Postings that are counted at once.
POSTINGS = 1 << 17
BROADCAST_BYTES = 64 << 20
#: One odd factor for each smallest hash.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + ONE


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band: of the smallest of the hashes by each of its orders (MinHash)."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1 << 12):
            least = np.minimum(least, (hashes[i : i + (1 << 12), None] * FACTORS).min(axis=0))
        keys = np.zeros(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_HASHES).T:
            keys = mixed(keys ^ column, 1)
    return keys


FULL = (1 << 64) - 1


def words_hash(text: bytes) -> int:
    """Alike for texts that differ only in white space or ASCII case."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED)


def near_signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, same, bands array, fp): a hash of the text and of its words, ``BANDS`` keys and the SimHash of the distinct five-word shingles."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                bands, prints, same = [], [], []
                for t in as_bytes(b.column("text")):
                    five = np.unique(shingle_hashes(t, SHINGLE))
                    bands.append(band_keys(five).view(np.int64))
                    prints.append(fingerprint(mixed(five, 1)))
                    same.append(words_hash(t))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), signed(same), pa.array(bands, pa.list_(pa.int64())), signed(prints)], ["id", "mark", "same", "bands", "fp"])

    texts = in_small_batches(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")))
    return texts.mapInArrow(run, f"id {kind}, mark long, same long, bands array<long>, fp long")


def most_bits(similarity: float) -> int:
    """The trie's budget: differing bits of fingerprints above which a similarity is excluded.

    Sets of this Jaccard similarity and equal size differ in a known share of their SimHash bits.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(64 * share + DOUBT * np.sqrt(64 * share * (1 - share))))


def candidate_links(classes: DataFrame, similarity: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that join candidates, of (id, bands, fp): members of a band's cell within the trie's budget.

    Cells with one member go first. What is in a cell of more than ``cell_rows`` members is linked to its smallest
    id without a look at the fingerprints: more candidates, which the exact counts have to part again.
    """
    cells = classes.select("id", "fp", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("cell"), "id", "fp")
    sized = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    live = checkpointed(cells.join(sized, "cell"))
    stars = live.where((F.col("n") > cell_rows) & (F.col("least") < F.col("id"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    return cell_links(live.where(F.col("n") <= cell_rows).select("cell", "id", "fp"), most_bits(similarity), None).union(stars).distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(id, component, n, shingles binary) of (id, component, same, text): the distinct five-word shingles of each
    text, as 32 bits of their hashes, and their number. A text that isn't of the class ``same``, where that
    isn't null, is another row of its id."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in byte_slices(batch, "text"):
                b = b.filter(pa.array([s is None or words_hash(t) == s & FULL for t, s in zip(as_bytes(b.column("text")), b.column("same").to_pylist())], pa.bool_()))
                sets = [np.unique(shingle_hashes(t, SHINGLE).astype(np.uint32)) for t in as_bytes(b.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("component"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["id", "component", "n", "shingles"],
                )

    return in_small_batches(texts.select("id", "component", "same", "text")).mapInArrow(run, f"id {kind}, component long, n long, shingles binary")


def as_sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint32) for x in column.to_pylist()]


def similar(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Links of a forest that joins sets (sorted, distinct) exactly as all pairs of this Jaccard similarity do.

    If there are two sides, only pairs across them count. A set is compared with all sets not yet joined to
    it, through the postings of its members; what ends in the largest tree need not be compared again.
    """
    m, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    owners = np.repeat(np.arange(m), sizes)
    _, value, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    posted, first, at = owners[np.argsort(value, kind="stable")], np.cumsum(df) - df, np.cumsum(sizes) - sizes
    root, waits, links, sided = np.arange(m), np.ones(m, dtype=bool), [], len(np.unique(side)) > 1
    while True:
        left = np.flatnonzero(waits & (root != np.bincount(root).argmax()))
        if not len(left):
            break
        i = int(left[0])
        waits[i] = False
        other = (root != root[i]) & (side != side[i] if sided else True)
        if not other.any():
            continue
        own = value[at[i] : at[i] + sizes[i]]
        spans = df[own]
        both = np.zeros(m, dtype=np.int64)
        cuts = np.r_[np.searchsorted(np.cumsum(spans), np.arange(0, spans.sum(), POSTINGS)), len(own)]
        for a, z in zip(cuts, cuts[1:]):  # the postings of all members at once would be too many where many sets are alike
            n = spans[a:z]
            both += np.bincount(posted[np.repeat(first[own[a:z]] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=m)
        found = np.flatnonzero(other & (both > 0) & (both >= similarity * (sizes + sizes[i] - both)))
        if len(found):
            # one link for each tree reached
            reached, one = np.unique(root[found], return_index=True)
            links += [(i, int(j)) for j in found[one]]
            root[np.isin(root, reached)] = root[i]
    return np.array(links, dtype=np.int64).reshape(-1, 2).T


def linked_in_cells(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of (cell, side, id, shingles) that join each cell's sets as all its pairs do, across its sides if it has two."""

    def joined(t: pa.Table) -> pa.RecordBatch:
        cell, side, ids = (t[c].to_numpy() for c in ("cell", "side", "id"))
        sets = as_sets(t["shingles"])
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        pairs = [similar(sets[x:z], side[x:z], similarity) + x for x, z in zip(starts, [*starts[1:], len(cell)]) if z - x > 1]
        a, b = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    parted = dealt.repartition("cell").sortWithinPartitions("cell", "side", "id")
    return parted.mapInArrow(lambda batches: by_cell(batches, joined), "a long, b long").where("a <> b").distinct()


def linked_to_pivots(sets: DataFrame, pivots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pivot of a component and a member of this similarity to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(as_sets(b.column("shingles")), as_sets(b.column("pivot"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    size = pivots.agg(F.coalesce(F.sum(F.octet_length("shingles").cast("long")), F.lit(0))).first()[0]
    chosen = pivots.select("component", F.col("id").alias("a"), F.col("shingles").alias("pivot"))
    both = sets.select("component", F.col("id").alias("b"), "shingles").join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, "component")
    return in_small_batches(both.select("a", "b", "shingles", "pivot")).mapInArrow(run, "a long, b long")


def large_links(sets: DataFrame, similarity: float, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Links (a, b) that join the members of large components (id, component, n, shingles) as all their pairs do.

    Members like a chosen one (a pivot) of their component are joined to it and done. The few that are left after some
    pivots are compared with all members of their component, chunk by chunk, so no task holds a component.
    """
    waiting, links = checkpointed(sets.select("id", "component").distinct()), None
    for _ in range(PIVOTS):
        first = waiting.groupBy("component").agg(F.min("id").alias("id"))  # a row for each large component
        pivots = checkpointed(sets.join(sent_whole(checkpointed(first)), ["component", "id"]))
        hits = checkpointed(linked_to_pivots(sets.join(sent_whole(checkpointed(first.select("component"))), "component", "left_semi"), pivots, similarity))
        links = hits if links is None else links.union(hits)
        done = hits.select(F.col("b").alias("id")).union(pivots.select("id")).distinct()
        waiting = checkpointed(waiting.join(sent_whole(checkpointed(done)), "id", "left_anti"))
        if waiting.isEmpty():
            return links
    left = checkpointed(sets.join(sent_whole(waiting), ["id", "component"], "left_semi"))
    chunks = lambda df, name: df.groupBy("component").agg(F.ceil(2 * F.sum("n") / cell_shingles).cast("int").alias(name))
    some = checkpointed(chunks(left, "rest").join(chunks(sets, "all"), "component"))  # a row for each component with a rest
    mine = lambda of: F.pmod(F.xxhash64("id", F.lit(11)), F.col(of)).cast("int")
    deal = lambda df, side, own, other: (
        df.join(F.broadcast(some), "component").withColumn("mine", mine(own)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select(F.xxhash64("component", *(("mine", "other") if side else ("other", "mine"))).alias("cell"), F.lit(side).alias("side"), "id", "shingles")
    )
    return links.union(linked_in_cells(deal(left, 1, "rest", "all").union(deal(sets, 0, "all", "rest")), similarity))


def held_links(links: DataFrame, df: DataFrame, similarity: float, id_col: str, text_col: str, cell_shingles: int = CELL_SHINGLES, classes: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join the ids, or the numbers of the ``classes`` (id, own, same), inside each component of the candidates ``links`` exactly as all pairs
    of this similarity of the five-word shingles do, whichever candidates the forests of the cells kept."""
    found = components(links)
    members = found.union(found.select("component", "component").distinct()).toDF("id", "component")
    if classes is None:
        members = checkpointed(members.withColumns({"_gl_own": F.col("id"), "same": F.lit(None).cast("long")}))
    else:
        members = checkpointed(classes.select("id", F.col("own").alias("_gl_own"), "same").join(sent_whole(checkpointed(members)), "id"))
    texts = df.select(F.col(id_col).alias("_gl_own"), F.col(text_col).alias("text")).join(sent_whole(members), "_gl_own")
    sets = checkpointed(shingle_sets(texts))
    large = checkpointed(sets.groupBy("component").agg(F.sum("n").alias("total")).where(F.col("total") > cell_shingles).select("component"))
    large = sent_whole(large)
    small = sets.join(large, "component", "left_anti").select(F.xxhash64("component").alias("cell"), F.lit(0).alias("side"), "id", "shingles")
    out = linked_in_cells(small, similarity)
    if large.isEmpty():
        return out
    return out.union(large_links(checkpointed(sets.join(large, "component", "left_semi")), similarity, cell_shingles).where("a <> b"))


def near_classes(df: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, own, node, group) of each row: ``mark`` is the text's hash, ``own`` the smallest id of its class, ``node``
    the class's number and ``group`` the least number that it is linked with."""
    ids = checkpointed(near_signatures(df, id_col, text_col))
    classes = ids.where(F.col("id").isNotNull()).groupBy("same").agg(F.min("id").alias("own"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    # a class has its smallest id for a number; where rows of one id have several texts, all but one class have a hash above all ids
    place = F.row_number().over(Window.partitionBy("own").orderBy("same"))
    other = F.xxhash64("own", "same").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    classes = checkpointed(classes.withColumn("place", place).withColumn("id", F.when(F.col("place") == 1, F.col("own")).otherwise(other)).drop("place"))
    empty = F.lit(int(np.uint64(xxhash.xxh64_intdigest(b"", SEED)).astype(np.int64)))
    links = checkpointed(candidate_links(classes.where(F.col("same") != empty), similarity))
    found = components(checkpointed(held_links(links, df, similarity, id_col, text_col, classes=classes)))
    named = classes.join(found, "id", "left").select("same", "own", F.col("id").alias("node"), F.coalesce("component", "id").alias("group"))
    alone = (F.col("same") == empty) | F.col("id").isNull()
    rows = ids.select("id", "mark", "same").join(named, "same", "left")
    return rows.select("id", "mark", *(F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c) for c in ("own", "node", "group")))


def near_groups(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group): texts of one group are linked by a five-word-shingle similarity of ``similarity`` or
    more; the group is its smallest id. Candidates agree on a band of smallest shingle hashes, and a binary trie
    self-join of their SimHash fingerprints drops what is far off. Whatever hangs together by candidates is then joined by exact
    counts only, of all its pairs. Texts that differ only in white space or ASCII case are one class. Null and wordless texts stay alone.
    Rows of one id are told apart by their texts; a group of such rows alone may have a hash above 2**62 for a name."""
    return near_classes(df, similarity, id_col, text_col).select("id", "group")


def drop_near_copies(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays: the one with the smallest id. Rows with a null id stay; of rows that share an id
    each text is a document."""
    rows = near_classes(df, similarity, id_col, text_col).where((F.col("node") != F.col("group")) | (F.col("id") != F.col("own")))
    gone = checkpointed(rows.select(F.col("id").alias("_gl_id"), F.col("mark").alias("_gl_mark")).distinct())
    return df.join(sent_whole(gone), (df[id_col] == F.col("_gl_id")) & (F.xxhash64(df[text_col]) == F.col("_gl_mark")), "left_anti")
