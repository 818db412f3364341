"""Hard negatives from blocks of vectors with zone maps.

Vectors become integers and are sorted along a Hilbert curve, so rows near one another lie in one block. Blocks are
written as Parquet with the least and largest value of each dimension. By interval arithmetic these bound the score
of an anchor with any row of a block, or of a group of blocks; only where the bounds meet an anchor's window, and
reach the scores that it has already, is the block read and scored.

At scale: anchors go to the groups that they need, never all rows to one place. A search takes two rounds: an anchor
first visits the square root of its groups, those with the highest bounds, and then with what it has found the rest
as far as bounds permit, so that both rounds return few rows a group. The map of groups has one row for
``GROUP_ROWS`` vectors and is sent to the tasks; its size is checked. A task holds one group and a batch of anchors.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_small_batches, shared_folder

BLOCK_ROWS = 256
#: Vectors in a group: what a task holds at once. Smaller tables have 64 groups, of this many rows at least.
GROUP_ROWS, LEAST_GROUP = 1 << 18, 1 << 10
#: Bits of the curve for each dimension, and dimensions that it runs through.
CURVE_BITS, CURVE_DIMS = 2, 64
#: Largest map of groups that is sent to tasks; beyond it groups would have to be larger.
MAP_BYTES = 256 << 20
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ANCHORS = 100
NONE = -(1 << 62)


def quantized(embeddings: DataFrame) -> DataFrame:
    """(id, label, vector array<long>): rows of label and vector with finite components, labels of ids divisible by 7 moved on."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    return embeddings.where(whole).select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("vector"),
    )


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places along the Hilbert curve of rows of non-negative coordinates of ``bits`` bits, as sortable bytes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # take back the turns of the coarser levels
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray, q = np.zeros(x.shape[1], dtype=np.int64), 1 << (bits - 1)
    while q > 1:
        gray ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= gray
    planes = [(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(n)]
    return [r.tobytes() for r in np.packbits(np.array(planes, dtype=np.uint8).T, axis=1)]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows of ``dims`` numbers; what a shorter one lacks is 0."""
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), dtype=np.int64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed(m: np.ndarray) -> bytes:
    """Numbers in the smallest of three widths, which the first byte names."""
    top = int(max(m.max(initial=0), -(m.min(initial=0) + 1)))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind[-1].encode() + m.astype(kind).tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i" + data[:1].decode(), offset=1).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of both."""
    size = a.shape[1] * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    if size < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if size < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    out = a.astype(object) @ b.astype(object).T
    if out.size and max(abs(out.min()), abs(out.max())) >= 1 << 62:
        raise OverflowError("a score does not fit into a long")
    return out.astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each row of ``a`` with anything between the rows of ``low`` and ``high``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    if a.shape[1] * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0))) >= 1 << 62:
        wide = np.full((len(a), len(low)), 1 << 62)  # too wide to be bounded in a long: never left out
        return -wide, wide
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


@dataclass
class Blocks:
    """Written blocks (group, block, ids, labels, low, high, vectors) and the map of their groups."""

    frame: DataFrame
    dims: int
    groups: np.ndarray
    low: np.ndarray
    high: np.ndarray


BLOCK = "group long, block long, ids array<long>, labels array<long>, low array<long>, high array<long>, vectors binary"


def write_blocks(rows: DataFrame) -> Blocks:
    """Sort ``rows`` (id, label, vector) along the curve and write them to the shared folder in blocks."""
    spark = rows.sparkSession
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    k = min(dims, CURVE_DIMS)
    spread = rows.agg(*(F.min(F.get("vector", F.lit(i))).alias(f"a{i}") for i in range(k)), *(F.max(F.get("vector", F.lit(i))).alias(f"z{i}") for i in range(k))).first() if k else ()
    least = np.array([x or 0 for x in spread[:k]], dtype=np.float64)
    width = np.maximum(np.array([x or 0 for x in spread[k:]], dtype=np.float64) - least, 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = np.floor((matrix(b.column(2), dims)[:, :k] - least) / width * ((1 << CURVE_BITS) - 0.001)) if k else np.zeros((b.num_rows, 1))
            cells = np.clip(cells, 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_keys(cells, CURVE_BITS), pa.binary())], ["id", "label", "vector", "place"])

    size = min(GROUP_ROWS, max(LEAST_GROUP, -(-n // 64)))
    placed = in_small_batches(rows).mapInArrow(keyed, "id long, label long, vector array<long>, place binary")
    placed = placed.repartitionByRange(max(1, -(-n // size)), "place", "id").sortWithinPartitions("place", "id", "label", "vector")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        for b in cut(batches, BLOCK_ROWS):
            m = matrix(b.column(2), dims)
            cells = [[(part << 20) + count * BLOCK_ROWS // (2 * GROUP_ROWS)], [count], [b.column(0)], [b.column(1)], [m.min(axis=0)], [m.max(axis=0)], [packed(m)]]
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["group", "block", "ids", "labels", "low", "high", "vectors"])
            count += 1

    at = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    in_small_batches(placed.select("id", "label", "vector")).mapInArrow(blocks, BLOCK).write.parquet(at)
    frame = spark.read.schema(BLOCK).parquet(at)
    if frame.select("group").distinct().count() * dims * 16 > MAP_BYTES:
        raise ValueError("the map of groups is too large to be sent; raise GROUP_ROWS")
    return Blocks(frame, dims, *group_map(frame, dims))


def cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``; the last may be smaller."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            held, n, b = [*held, part], n + part.num_rows, b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_map(frame: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups with the least and largest value of each dimension, from the blocks' maps alone."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for b in batches:
            for g, x, z in zip(b.column(0).to_pylist(), matrix(b.column(1), dims), matrix(b.column(2), dims)):
                low[g], high[g] = np.minimum(low.get(g, x), x), np.maximum(high.get(g, z), z)
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip((low, low.values(), high.values()), kinds)], ["group", "low", "high"])

    low, high = {}, {}
    # a group lies in one file, so there are few rows beside one a group, and their size has been checked
    for g, x, z in frame.select("group", "low", "high").mapInArrow(partial, "group long, low array<long>, high array<long>").collect():
        x, z = np.array(x, dtype=np.int64), np.array(z, dtype=np.int64)
        low[g], high[g] = np.minimum(low.get(g, x), x), np.maximum(high.get(g, z), z)
    groups = np.array(sorted(low), dtype=np.int64)
    table = lambda by: np.array([by[g] for g in groups], dtype=np.int64).reshape(len(groups), dims)
    return groups, table(low), table(high)


REQUEST = "anchor long, id long, label long, vector binary, lows array<long>, highs array<long>"
WANTED = f"group long, {REQUEST}"
HIT = "anchor long, slot long, score long, id long, row long"


def anchors_of(blocks: Blocks, every: int = ANCHORS) -> DataFrame:
    """Rows whose id is divisible by ``every``; ``anchor`` names the row, with one window without bounds."""
    dims = blocks.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, k, ids, labels, data in zip(*(b.column(c).to_pylist() for c in ("group", "block", "ids", "labels", "vectors"))):
                m = unpacked(data, dims)
                out += [(row_number(g, k, i), x, labels[i], packed(m[i : i + 1]), [NONE], [-NONE]) for i, x in enumerate(ids) if x is not None and x % every == 0]
            yield as_batch(out, REQUEST)

    return blocks.frame.select("group", "block", "ids", "labels", "vectors").mapInArrow(run, REQUEST)


def row_number(group: int, block: int, i: int) -> int:
    """A number of a row: partition, block in it, place in that."""
    return (group >> 20) << 40 | block * BLOCK_ROWS + i


ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(cols, kinds)], list(names))


def vectors_of(b: pa.RecordBatch, dims: int) -> np.ndarray:
    data = b.column("vector").to_pylist()
    return np.concatenate([unpacked(x, dims).astype(np.int64) for x in data]) if data else np.zeros((0, dims), dtype=np.int64)


def routed(requests: DataFrame, blocks: Blocks, rest: bool) -> DataFrame:
    """Requests, once for each group whose bounds meet one of their windows: the square root of them that reach
    highest, or with ``rest`` the others."""
    shared = requests.sparkSession.sparkContext.broadcast((blocks.groups, blocks.low, blocks.high))
    dims, first = blocks.dims, math.isqrt(max(0, len(blocks.groups) - 1)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, low, high = shared.value
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                least, most = bounds(vectors_of(b, dims), low, high)
                order = np.argsort(-most, axis=1, kind="stable")
                row, to = [], []
                for i, (lows, highs, seen) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lows", "highs", "seen")))):
                    mine = order[i][first:] if rest else order[i][:first]
                    # the windows as the first round has left them: rows below what it found are not wanted
                    need = np.zeros(len(mine), dtype=bool)
                    for x, z, s in zip(lows, highs, seen):
                        need |= (most[i, mine] >= max(x, s)) & (least[i, mine] <= z)
                    to += groups[mine[need]].tolist()
                    row += [i] * int(need.sum())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *(c.take(pa.array(row, pa.int64())) for c in b.columns)], ["group", *b.schema.names])

    return in_small_batches(requests).mapInArrow(run, f"{WANTED}, seen array<long>")


#: Blocks that are scored at once, and anchors.
BLOCKS_AT_ONCE, ANCHORS_AT_ONCE = 16, 256
NO_ID = (1 << 63) - 1


class Group:
    """The blocks of one group, in the order in which they came."""

    def __init__(self, number: int):
        self.number, self.rows = number, []

    def add(self, block: int, x: dict) -> None:
        self.rows.append((block, x))

    def laid(self, dims: int) -> None:
        """Lay the blocks end to end; called once, when all are there."""
        if self.rows is None:
            return
        data = [unpacked(x["vectors"], dims) for _, x in self.rows]
        self.sizes = np.array([len(v) for v in data], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.vectors = np.concatenate(data)
        self.ids = np.array([NO_ID if i is None else i for _, x in self.rows for i in x["ids"]], dtype=np.int64)
        self.labels = np.array([i for _, x in self.rows for i in x["labels"]], dtype=np.int64)
        self.low, self.high = (np.array([x[c] for _, x in self.rows], dtype=np.int64).reshape(-1, dims) for c in ("low", "high"))
        self.numbers = np.array([row_number(self.number, b, i) for (b, _), n in zip(self.rows, self.sizes) for i in range(n)], dtype=np.int64)
        self.rows = None

    def search(self, requests: list[dict], dims: int, k: int, same: bool) -> list[tuple]:
        """Hits of some requests: for each window the first ``k`` rows of the same or of other labels."""
        a = np.concatenate([unpacked(r["vector"], dims).astype(np.int64) for r in requests])
        least, most = bounds(a, self.low, self.high)
        found = [[(np.zeros(0, dtype=np.int64),) * 3 for _ in r["lows"]] for r in requests]
        seen = [[max(x, s) for x, s in zip(r["lows"], r["seen"])] for r in requests]
        # blocks that reach highest come first, so that what they hold spares others
        order = np.argsort(-most.max(axis=0), kind="stable")
        for chunk in (order[i : i + BLOCKS_AT_ONCE] for i in range(0, len(order), BLOCKS_AT_ONCE)):
            need = [any(((most[i, chunk] >= s) & (least[i, chunk] <= z)).any() for s, z in zip(seen[i], r["highs"])) for i, r in enumerate(requests)]
            who = np.flatnonzero(need)
            if not len(who):
                continue
            at = np.concatenate([np.arange(self.starts[b], self.starts[b + 1]) for b in chunk])
            scores, labels, ids, numbers = products(a[who], self.vectors[at]), self.labels[at], self.ids[at], self.numbers[at]
            for i, s in zip(who, scores):
                r = requests[i]
                fits = (labels == r["label"]) & (numbers != r["anchor"]) if same else labels != r["label"]
                for w, z in enumerate(r["highs"]):
                    hit = np.flatnonzero(fits & (s >= seen[i][w]) & (s <= z))
                    if not len(hit):
                        continue
                    if len(hit) > k:
                        hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
                    both = [np.concatenate(c) for c in zip(found[i][w], (s[hit], ids[hit], numbers[hit]))]
                    first = np.lexsort((both[2], both[1], -both[0]))[:k]
                    found[i][w] = tuple(c[first] for c in both)
                    if len(first) == k:
                        seen[i][w] = max(seen[i][w], int(both[0][first[-1]]))
        return [
            (r["anchor"], w, s, None if x == NO_ID else x, n)
            for r, windows in zip(requests, found) for w, cols in enumerate(windows) for s, x, n in zip(*(c.tolist() for c in cols))
        ]


def visited(routes: DataFrame, blocks: Blocks, k: int, same: bool) -> DataFrame:
    """Hits of requests in the groups to which they are routed."""
    dims = blocks.dims
    block = F.struct("ids", "labels", "low", "high", "vectors")
    request = F.struct("anchor", "label", "vector", "lows", "highs", "seen")
    both = blocks.frame.select("group", F.lit(0).alias("kind"), "block", block.alias("own"), F.lit(None).alias("request"))
    both = both.unionByName(routes.select("group", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(None).alias("own"), request.alias("request")))
    both = both.repartition("group").sortWithinPartitions("group", "kind", "block").select("group", "block", "own", "request")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting = None, []

        def answered() -> pa.RecordBatch:
            group.laid(dims)
            return as_batch(group.search(waiting, dims, k, same), HIT)

        for b in batches:
            for g, number, own, request in zip(*(c.to_pylist() for c in b.columns)):
                if group is None or g != group.number:
                    if waiting:
                        yield answered()
                    group, waiting = Group(g), []
                if own is not None:
                    group.add(number, own)
                    continue
                waiting.append(request)
                if len(waiting) == ANCHORS_AT_ONCE:
                    yield answered()
                    waiting = []
        if waiting:
            yield answered()

    return in_small_batches(both).mapInArrow(run, HIT)


def first_ones(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each anchor and window, numbered from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(requests: DataFrame, blocks: Blocks, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, row, rank): for each window of the requests the first ``k`` rows in it."""
    start = requests.withColumn("seen", F.col("lows"))
    early = checkpointed(first_ones(visited(routed(start, blocks, False), blocks, k, same), k))
    reached = early.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("by"))  # 5 windows at most
    slot = F.sequence(F.lit(0), F.size("lows") - 1)
    seen = F.transform(slot, lambda i: F.coalesce(F.try_element_at("by", i.cast("long")), F.lit(NONE)))
    later = requests.join(reached, "anchor", "left").withColumn("seen", F.when(F.col("by").isNull(), F.col("lows")).otherwise(seen)).drop("by")
    late = visited(routed(later, blocks, True), blocks, k, same)
    return first_ones(early.drop("rank").unionByName(late), k)


def mine(embeddings: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor (rows whose vec_id is divisible by ``every``) and each of its first ``positives`` other rows of its
    label the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    Scores are inner products of floor(256 * x); higher ones come first, ties by smaller vec_id, then a null one, then by
    place. Rows with a null label or vector or with a component that is null or not finite take no part; a row with a null
    vec_id can be found, but is no anchor. What a shorter vector lacks counts as 0. Rows that share a vec_id are rows of
    their own. A positive below 0 has no window. An empty table gives no rows.
    """
    blocks = write_blocks(quantized(embeddings))
    requests = checkpointed(anchors_of(blocks, every))
    near = checkpointed(search(requests, blocks, positives, True))
    part = lambda n: F.col("score").cast("decimal(19,0)") * F.lit(n).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
    windows = (
        near.where("score >= 0").withColumn("slot", F.col("rank") - 1)
        .select("anchor", F.struct("slot", F.ceil(part(low)).cast("long").alias("low"), F.floor(part(high)).cast("long").alias("high")).alias("w"))
        .groupBy("anchor").agg(F.array_sort(F.collect_list("w")).alias("w"))
    )
    asked = requests.drop("lows", "highs").join(windows, "anchor").select("anchor", "id", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    hard = search(asked, blocks, negatives, False)
    own = near.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        hard.join(own, ["anchor", "slot"]).join(requests.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op11_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """A row for each anchor, positive and hard negative of ``embeddings``: see :func:`mine`."""
    return mine(embeddings)


SQL = f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score FROM v a JOIN v b ON a.id % {ANCHORS} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}"""
