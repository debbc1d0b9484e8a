"""Greedy longest-match token counts in linear time (after LinMaxMatch, Song et al., 2021).

The vocabulary's trie has a failure link at each node: where the longest match of what is read ends and the next piece
begins. Counting needs no pieces, only how many of them a failure pops; these counts are worked out once. All distinct words
of a batch go through the automaton together, one byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, prefix_hash, span_hash, text_chunks, word_spans

WORD_MARK = "▁"


class Automaton:
    """Node 0 reads a word's first piece, node 1 the pieces that continue it."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        child: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                node = root
                for byte in piece.encode():
                    if byte not in child[node]:
                        child[node][byte] = len(child)
                        child.append({})
                        whole.append(False)
                    node = child[node][byte]
                if node != root:
                    whole[node] = True
        link, pops = [-1] * len(child), [0] * len(child)
        level = [0, 1]
        while level:  # breadth first: links of shorter strings are known
            below = []
            for parent in level:
                for byte, node in child[parent].items():
                    below.append(node)
                    if whole[node]:
                        link[node], pops[node] = 1, 1
                        continue
                    at, n = link[parent], pops[parent]
                    while at >= 0 and byte not in child[at]:
                        n += pops[at]
                        at = link[at]
                    if at >= 0:
                        link[node], pops[node] = child[at][byte], n
            level = below
        edges = sorted((node << 8 | byte, to) for node, out in enumerate(child) for byte, to in out.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int32)
        self.link, self.pops = np.array(link, np.int32), np.array(pops, np.int32)

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(state), -1, np.int32)
        key = state.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; 0 for a word that the vocabulary can't spell."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still being read are a prefix
        begin, length = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        alive = np.ones(len(order), bool)
        for k in range(int(length[0]) if len(length) else 0):
            at = np.flatnonzero(alive[: np.searchsorted(-length, -k, side="left")])
            if not len(at):
                break
            byte = data[begin[at] + k]
            while len(at):
                to = self._next(state[at], byte)
                ok = to >= 0
                state[at[ok]] = to[ok]
                at, byte = at[~ok], byte[~ok]
                at, byte = self._fail(at, byte, state, total, alive)
        at = np.flatnonzero(alive & (state != 1))
        while len(at):
            at, _ = self._fail(at, at, state, total, alive)
            at = at[state[at] != 1]
        out = np.zeros(len(order), np.int64)
        out[order] = np.where(alive, total, 0)
        return out

    def _fail(self, at, byte, state, total, alive):
        """Follow one failure link; words without one are lost."""
        node = state[at]
        link = self.link[node]
        lost = link < 0
        alive[at[lost]] = False
        at, node, link = at[~lost], node[~lost], link[~lost]
        total[at] += self.pops[node]
        state[at] = link
        return at, byte[~lost]


def marked_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(first pieces, inner pieces) of a sentencepiece file: a word's first piece carries the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    first = [p[1:] for p in usable if p.startswith(WORD_MARK) and len(p) > 1 and WORD_MARK not in p[1:]]
    return first, [p for p in usable if WORD_MARK not in p]


def token_counts(docs: DataFrame, first: list[str], inner: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id column, n_words, n_tokens, n_unknown, longs.

    A word is a run without ASCII white space; its pieces are the longest prefix in `first`, then again and again the
    longest prefix of the rest in `inner`. A word that can't be spelt so counts as one unknown token, included in n_tokens.
    Null and empty texts have 0 of each. Ids may be null or repeat: rows stay apart. Other columns aren't read. An empty
    table gives no rows. What is broadcast is the vocabulary's automaton, whose size the corpus doesn't touch.
    """
    frame = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", frame.schema["id"].dataType)] + [T.StructField(x, T.LongType()) for x in ("n_words", "n_tokens", "n_unknown")])
    shipped = docs.sparkSession.sparkContext.broadcast(Automaton(first, inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shipped.value
        for batch in batches:
            ids = column_of(batch, "id")
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                starts, ends, before = word_spans(data, offsets, "space")
                _, one, which = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
                pieces = automaton.counts(data, starts[one], ends[one])[which]
                unknown = np.concatenate([[0], np.cumsum(pieces == 0)])
                total = np.concatenate([[0], np.cumsum(np.maximum(pieces, 1))])
                columns = [np.diff(before), np.diff(total[before]), np.diff(unknown[before])]
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(offsets) - 1), *map(pa.array, columns)], names=schema.names)

    return frame.mapInArrow(run, schema).withColumnRenamed("id", id_column)
