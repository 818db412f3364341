"""Greedy word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary gets failure links: where a character can't go on, the longest pieces that
the path holds are popped and the walk goes on at the node of what is left. How many pieces pop is
computed with the link, so a word's token count needs one pass over it and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, byte_slices, in_small_batches, sent

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the start of a word in the vocabulary.
MARK = "▁"
#: Words whose counts a task remembers.
REMEMBERED = 150_000


def pieces_of(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]


class LengthAutomaton:
    def __init__(self, pieces: list[str]):
        self.goto: dict[int, int] = {}
        self.fail, self.pops = [-1], [0]
        ends, order = set(), [(0, 0, 0)]
        children: list[list[tuple[int, int]]] = [[]]
        for p in pieces:
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in self.goto:
                    self.goto[key] = len(children)
                    children[at].append((ord(c), len(children)))
                    children.append([])
                at = self.goto[key]
            ends.add(at)
        self.fail, self.pops = [-1] * len(children), [0] * len(children)
        order = [0]
        for u in order:
            for c, v in children[u]:
                order.append(v)
                if v in ends:  # the whole path is a piece: it pops, and nothing is left
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                w, n = self.fail[u], self.pops[u]
                while w >= 0 and w << 21 | c not in self.goto:
                    n, w = n + self.pops[w], self.fail[w]
                if w >= 0:
                    self.fail[v], self.pops[v] = self.goto[w << 21 | c], n

    def count(self, word: str) -> int:
        """Pieces that greedy longest match from the left takes for a word; 0: some part has no piece."""
        goto, fail, pops, at, n = self.goto.get, self.fail, self.pops, 0, 0
        for c in map(ord, word):
            while (to := goto(at << 21 | c)) is None:
                if fail[at] < 0:
                    return 0
                n, at = n + pops[at], fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return 0
            n, at = n + pops[at], fail[at]
        return n


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown): words are split at white space; a word that the vocabulary
    can't spell counts as one unknown token. Null and empty texts have no words. One row for each row."""
    shared = sent(df.sparkSession, LengthAutomaton(pieces_of(vocabulary)))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = shared().count, {}
        for whole in batches:
            for b in byte_slices(whole, "text"):
                out = []
                for text in as_texts(b.column(1)):
                    words = text.split()
                    n = unknown = 0
                    for w in words:
                        x = known.get(w)
                        if x is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            x = known[w] = count(MARK + w)
                        n += x or 1
                        unknown += not x
                    out.append((len(words), n, unknown))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["id", "n_words", "n_tokens", "n_unknown"])

    out = in_small_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def op9_token_counts(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; a null text has no words."""
    return token_counts(docs)
