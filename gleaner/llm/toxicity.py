"""Toxic spans by a linear-chain conditional random field.

Two states, clean and toxic; a token's features are the word and its beginnings. Forward-backward
marginals give each token's probability to be toxic; a logistic function of their largest value, sum
and mean is the document's score, and runs of likely tokens are the offending spans.

Labels are given for documents. Token labels follow from them: in a toxic document those tokens are
labelled toxic that have a feature found almost only in toxic documents. The field is fitted on the
driver on a bounded sample of labelled rows (at most ``SAMPLE`` documents and ``SAMPLE_CHARS`` characters a class, chosen by hash, copies and
near copies left out); everything is scored in tasks.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_texts, byte_slices, in_small_batches, sent

TOKEN = re.compile(r"[^\W_]+")
SAMPLE = {1: 1000, 0: 2000}
#: Characters of each class's sample: it is bounded in size too.
SAMPLE_CHARS = {1: 5 << 19, 0: 4 << 20}
BEGINNINGS = (4, 5, 6)
#: A marker: so large a share of its documents is toxic (with both labels weighed alike), and chance
#: would give its counts with a probability of 10 to minus this.
MARKER_SHARE, MARKER_EVIDENCE = 0.95, 5.0
FEATURES = 20_000
SPAN_PROBABILITY = 0.5
THRESHOLD = 0.3
BATCH_BYTES = 2 << 20


def features(word: str) -> list[str]:
    return [word, *(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; as many as the text itself has, also where lower case changes a text's length."""
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in TOKEN.findall(text)]


def sample_of(docs: DataFrame, labelled: DataFrame) -> list[tuple[str, int]]:
    """(text, label): of each label the texts with the smallest hashes of their ids, near copies left out.

    Lengths are looked at first: what is fetched holds at most ``SAMPLE_CHARS`` characters of a label.
    """
    spark, few = docs.sparkSession, []
    for label in (0, 1):
        own = labelled.where(F.col("label") == label).select("doc_id", "label", F.xxhash64("doc_id", F.lit(5)).alias("_gl_at"))
        few.append(own.orderBy("_gl_at", "doc_id").limit(SAMPLE[label]))  # bounded, so it can be broadcast
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_gl_text"))
    sized = texts.join(F.broadcast(few[0].union(few[1])), "doc_id").groupBy("label", "_gl_at", "doc_id", "_gl_text").agg(F.first(F.length("text")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_gl_at", "n", "_gl_text"))
    most = F.when(F.col("label") == 1, SAMPLE[1]).otherwise(SAMPLE[0])
    left, wanted = dict(SAMPLE_CHARS), []
    for r in sized.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("label", "rank").collect():
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            wanted.append((r.doc_id, r._gl_text, r.label, len(wanted)))
    if not wanted:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(wanted, f"doc_id {kind}, _gl_text long, label int, place int"))
    fetched = {r.place: r for r in texts.join(chosen, ["doc_id", "_gl_text"]).groupBy("place").agg(F.first("text").alias("text"), F.first("label").alias("label")).collect()}
    out, seen = [], set()
    for _, r in sorted(fetched.items()):
        words = r.text.lower().split()
        grams = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        least = {(r.label, s, min(g * s & 0xFFFFFFFFFFFFFFFF for g in grams)) for s in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)}
        if not least & seen:
            seen |= least
            out.append((r.text, r.label))
    return out


class Field:
    """A fitted field: weights of features, arcs, and the logistic function of a document's marginals."""

    def __init__(self, weights: dict[str, float], bias: float, arcs: np.ndarray, logistic: np.ndarray):
        self.weights, self.bias, self.arcs, self.logistic = weights, bias, arcs, logistic

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def document(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        x = summary(p, sizes)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(1, largest marginal, log of their sum, mean) of each document; an empty one has zeros."""
    x = np.zeros((len(sizes), 4))
    x[:, 0] = 1
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        total = np.add.reduceat(p, starts)
        x[full, 1], x[full, 2], x[full, 3] = np.maximum.reduceat(p, starts), np.log1p(total), total / sizes[full]
    return x


class Emissions(dict):
    """Emission of each word, computed when it is first met."""

    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) > 60_000:
            self.clear()
        x = self[word] = self.field.emission(word)
        return x


def fit(sample: list[tuple[str, int]], share_toxic: float, rounds: int = 40) -> Field:
    """Fit on (text, label). Without both labels every score is the share of toxic rows."""
    share = min(max(share_toxic, 1e-4), 1 - 1e-4)
    flat = Field({}, -8.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0]))
    docs = [([sys.intern(w) for w in tokens_of(t)], y) for t, y in sample]
    n_toxic = sum(y for _, y in docs)
    if not n_toxic or n_toxic == len(docs):
        return flat
    toxic, clean = Counter(), Counter()
    for words, _ in (d for d in docs if d[1]):
        toxic.update({f for w in set(words) for f in features(w)})
    toxic = Counter({f: c for f, c in toxic.items() if c >= 3})
    for words, _ in (d for d in docs if not d[1]):
        clean.update({f for w in set(words) for f in features(w) if f in toxic})
    even = (len(docs) - n_toxic) / n_toxic  # as if both labels were equally many
    chosen = sorted(toxic, key=lambda f: (-(toxic[f] * np.log((toxic[f] * even + 0.5) / (clean[f] + 0.5))), f))
    index = {f: i for i, f in enumerate(chosen[:FEATURES])}
    share_here = n_toxic / len(docs)

    def marks(f: str) -> bool:
        t, c = toxic[f], clean[f]
        evidence = t * np.log10(t / (t + c) / share_here) + (c * np.log10(c / (t + c) / (1 - share_here)) if c else 0)
        return t * even >= MARKER_SHARE * (t * even + c) and evidence >= min(MARKER_EVIDENCE, n_toxic / 5)

    marker = {f for f in index if marks(f)}
    of_word: dict[str, tuple[list[int], bool]] = {}  # words with a feature only
    for w in {w for words, _ in docs for w in words}:
        fs = [f for f in features(w) if f in index]
        if fs:
            of_word[w] = ([index[f] for f in fs], any(f in marker for f in fs))
    # windows of whole documents, so that sequences have like lengths
    sizes, labels, at_token, at_feature, n = [], [], [], [], 0
    for words, y in docs:
        for k in range(0, len(words), 256):
            window = words[k : k + 256]
            sizes.append(len(window))
            for w in window:
                fs, mark = of_word.get(w, ((), False))
                labels.append(int(mark and y))
                at_token += [n] * len(fs)
                at_feature += fs
                n += 1
    sizes, y = np.array(sizes), np.array(labels, dtype=np.float64)
    at_token, at_feature = np.array(at_token, dtype=np.int64), np.array(at_feature, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    w, bias, arcs = np.zeros(len(index)), -3.0, np.zeros((2, 2))
    m, v = np.zeros(len(index) + 5), np.zeros(len(index) + 5)
    seen = np.zeros((2, 2))
    yi = y.astype(int)
    np.add.at(seen, (yi[inner - 1], yi[inner]), 1)
    for step in range(1, rounds + 1):
        emission = bias + np.bincount(at_token, w[at_feature], n)
        p, joint = chain(emission, sizes, arcs, inner)
        grad = np.r_[np.bincount(at_feature, (y - p)[at_token], len(index)) - 0.5 * w, (y - p).sum(), (seen - joint).ravel()]
        m, v = 0.8 * m + 0.2 * grad, 0.95 * v + 0.05 * grad**2
        move = 0.5 / np.sqrt(step) * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8)
        w, bias, arcs = w + move[:-5], bias + move[-5], np.clip(arcs + move[-4:].reshape(2, 2), -6, 6)
    field = Field({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(bias), arcs, flat.logistic)
    # the documents' logistic function, with the labels' true shares
    lengths = np.array([len(words) for words, _ in docs])
    cache = Emissions(field)
    p, _ = chain(np.array([cache[w] for words, _ in docs for w in words]), lengths, arcs)
    x, label = summary(p, lengths), np.array([y for _, y in docs], dtype=np.float64)
    weight = np.where(label == 1, share * len(docs) / n_toxic, (1 - share) * len(docs) / (len(docs) - n_toxic))
    field.logistic = logistic(x, label, weight, flat.logistic)
    return field


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton steps that are halved until the loss falls."""
    ridge = np.array([1e-6, 0.3, 0.3, 0.3])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - label * z)).sum() + (ridge * b * b).sum() / 2)

    b = start.copy()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (label - q)) - ridge * b
        move = np.linalg.solve((x * (weight * q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-6 and loss(b + size * move) > loss(b):
            size /= 2
        b = b + size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return b


def chain(emission: np.ndarray, sizes: np.ndarray, arcs: np.ndarray, inner: np.ndarray | None = None):
    """Marginals of sequences laid end to end, and with ``inner`` (tokens that have one before them) the
    expected number of each pair of states. Forward and backward carry the quotient of the two states'
    weights, for all sequences at once, from token to token."""
    t, n = np.exp(arcs), len(emission)
    rise = np.exp(np.clip(emission, -30, 30))
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    long, begin = sizes[order], begin[order]
    top = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(top), side="left")  # sequences longer than k
    forward, backward = np.empty(n), np.empty(n)
    r = None
    for k in range(top):
        i = begin[: active[k]] + k
        r = rise[i] if r is None else rise[i] * (t[0, 1] + r[: len(i)] * t[1, 1]) / (t[0, 0] + r[: len(i)] * t[1, 0])
        forward[i] = r
    b = np.ones(0)
    for k in range(top - 1, -1, -1):
        i = begin[: active[k]] + k
        x = b * rise[i[: len(b)] + 1] if len(b) else b
        nxt = np.ones(len(i))
        nxt[: len(b)] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        b = nxt
        backward[i] = b
    q = forward * backward
    p = q / (1 + q)
    if inner is None:
        return p, None
    f, g = forward[inner - 1], rise[inner] * backward[inner]
    cells = np.stack([np.full(len(f), t[0, 0]), t[0, 1] * g, t[1, 0] * f, t[1, 1] * f * g])
    return p, (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of SPAN_PROBABILITY or more: character offsets and the largest marginal."""
    out, last = [], -2
    for k, found in enumerate(TOKEN.finditer(text)):
        if k < len(p) and p[k] >= SPAN_PROBABILITY:
            if last == k - 1:
                out[-1]["end"], out[-1]["p"] = found.end(), max(out[-1]["p"], float(p[k]))
            else:
                out.append({"start": found.start(), "end": found.end(), "p": float(p[k])})
            last = k
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Field:
    """Fit on rows of ``docs`` for which ``learn`` holds. Counts of labels cover all of them; only the fit
    is on a sample. Rows with a null id or a label other than 0 and 1 teach nothing."""
    own = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    rows = docs.where(learn).select("doc_id").join(own, "doc_id")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    return fit(sample_of(docs.where(learn), rows.distinct()), toxic / n if n else 0.0)


def score_documents(df: DataFrame, field: Field, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``df`` with ``out_col``: struct(score, spans array<struct(start, end, p)>). Null and empty texts
    get the score of a text without tokens and no spans. A column named ``out_col`` is replaced."""
    names = [c for c in df.columns if c != out_col]
    shared = sent(df.sparkSession, field)
    span = T.StructType().add("start", "integer").add("end", "integer").add("p", "double")
    schema = df.select(*names).schema.add(out_col, T.StructType().add("score", "double").add("spans", T.ArrayType(span)))
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared()
        cache, at = Emissions(field), names.index(text_col)
        for whole in batches:
            for b in byte_slices(whole, text_col, BATCH_BYTES):
                texts = as_texts(b.column(at))
                parts = [np.array([cache[w] for w in tokens_of(t)], dtype=np.float64) for t in texts]
                sizes = np.array([len(x) for x in parts])
                p, _ = chain(np.concatenate(parts), sizes, field.arcs)
                scores, starts = field.document(p, sizes), np.cumsum(sizes) - sizes
                likely = np.flatnonzero(p >= SPAN_PROBABILITY)
                hit = set((np.searchsorted(starts + sizes, likely, side="right")).tolist())
                spans = [spans_of(t, p[a : a + n]) if k in hit else [] for k, (t, a, n) in enumerate(zip(texts, starts, sizes))]
                out = pa.array([{"score": float(s), "spans": x} for s, x in zip(scores, spans)], kind)
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*names, out_col])

    return in_small_batches(df.select(*names)).mapInArrow(run, schema)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score under the threshold, with their own columns."""
    field = train(docs.select("doc_id", "text"), labels, F.coalesce(fold() != 2, F.lit(False)))
    return score_documents(docs, field, out_col="_gl_toxicity").where(F.col("_gl_toxicity.score") < threshold).drop("_gl_toxicity")


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; a null id is not held out, null and empty texts score as texts without tokens."""
    held_out = F.coalesce(fold() == 2, F.lit(False))
    docs = docs.select("doc_id", "text")
    out = score_documents(docs, train(docs, labels, ~held_out))
    score = F.col("toxicity.score")
    return out.select(
        "doc_id", held_out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.spans").cast("long").alias("n_spans"),
    )
