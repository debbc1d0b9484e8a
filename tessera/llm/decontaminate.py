"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity.

A window has as many words as an item (the whole text if that is shorter). Similarity: weight of the shared shingles over
weight of all, once with each shingle weighing 1 and once with its rarity over all documents,
log((1 + N) / (1 + df)) / log(1 + N); 1 for shingles that no item has. A window matches if either reaches the threshold: plain
similarity does not fall with the number of documents that hold a passage, weighted similarity finds what only frequent
shingles change.

For each of the two kinds of weights, only windows whose known shingles weigh the threshold's share of the lightest item of
their length can match, so only they get a fingerprint: the signs of the weighted sum of their shingles' bits. Fingerprints
are cut into blocks; if two are within the radius, one block at least is within radius // blocks, so the table of all values
near each item's blocks finds every fingerprint within the radius. Candidates of either kind are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, all_columns, column_of, cut, drop_cut, free_name, mix, sized, text_chunks, word_hashes

BLOCKS, RADIUS = 5, 19
KINDS = ("plain", "weighted")
EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
FILTER_BITS = 20


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * np.uint64(pow(BASE, k + 1, 1 << 64))
    return mix(out)


def signs(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def block_values(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)]


class Items:
    """The items of one block of the benchmark, ready for search."""

    def __init__(self, names: list, texts: list[str], n: int):
        self.names, self.n = names, n
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, before, _, _ = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, "alnum")
        self.length = np.diff(before)
        self.sets = [np.unique(runs(words[before[i] : before[i + 1]], min(n, int(self.length[i])))) if self.length[i] else np.zeros(0, np.uint64) for i in range(len(raw))]
        self.lists = [runs(words[before[i] : before[i + 1]], min(n, int(self.length[i]))) if self.length[i] else np.zeros(0, np.uint64) for i in range(len(raw))]
        self.vocabulary = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.vocabulary >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.sizes = sorted({min(n, int(x)) for x in self.length if x})
        self.weights = np.ones(len(self.vocabulary))

    def index(self) -> None:
        """For each kind of weights: fingerprints, the lightest item of each window length and, for each length and block, all
        values within the block's radius of an item's."""
        self.prints: dict[str, np.ndarray] = {}
        self.lightest: dict[tuple[str, int], float] = {}
        self.tables: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.lengths = sorted(set(self.length[self.length > 0].tolist()))
        for kind in KINDS:
            weigh = self.weight if kind == "weighted" else lambda h: np.ones(len(h))
            self.prints[kind] = np.array([fingerprint((signs(h) * weigh(h)[:, None]).sum(0)[None])[0] if len(h) else 0 for h in self.lists], np.uint64)
            for length in self.lengths:
                mine, tables = np.flatnonzero(self.length == length), []
                for (a, b), values in zip(zip(EDGES[:-1], EDGES[1:], strict=True), block_values(self.prints[kind][mine]), strict=True):
                    flips = np.array([sum(1 << x for x in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(b - a), r)], np.uint64)
                    near = (values[:, None] ^ flips[None]).reshape(-1).astype(np.uint16)
                    order = np.argsort(near, kind="stable")
                    tables.append((near[order], np.repeat(mine.astype(np.int32), len(flips))[order]))
                self.tables[kind, length] = tables
                self.lightest[kind, length] = min(float(weigh(self.sets[i]).sum()) for i in mine)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        hit = self.filter[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        at = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), max(len(self.vocabulary) - 1, 0))
        hit[at] = self.vocabulary[place] == hashes[at] if len(self.vocabulary) else False
        return hit

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        at = np.flatnonzero(self.known(hashes))
        out[at] = self.weights[np.searchsorted(self.vocabulary, hashes[at])]
        return out

    def may_hold(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """False for rows that have no shingle of any item; rows shorter than a shingle aren't judged."""
        out = np.diff(before) < (self.sizes[-1] if self.sizes else 0)
        for n in self.sizes:
            hashes = runs(words, n)
            at = np.flatnonzero(self.known(hashes)) if len(hashes) else np.zeros(0, int)
            row = np.searchsorted(before, at, side="right") - 1
            out[row[at + n <= before[row + 1]]] = True
        return out

    def candidates(self, kind: str, length: int, prints: np.ndarray) -> np.ndarray:
        """(place in prints, item) of all items of a length whose fingerprint is within the radius."""
        windows, items = [], []
        for (near, owner), values in zip(self.tables[kind, length], block_values(prints), strict=True):
            values = values.astype(np.uint16)
            low, high = np.searchsorted(near, values, "left"), np.searchsorted(near, values, "right")
            many = high - low
            windows.append(np.repeat(np.arange(len(prints)), many))
            items.append(owner[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))])
        pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(items)], 1), axis=0)
        return pairs[np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[kind][pairs[:, 1]]) <= RADIUS]

    def search(self, words: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, Hamming distance): the best window of a text for each item that has one.
        similarity is the weighted one where that reaches least, otherwise the plain one; the former are better. The distance
        is that of the fingerprints of the same kind of weights."""
        best: dict[int, tuple[bool, float, int, int, int]] = {}
        for n in self.sizes:
            hashes = runs(words, n) if len(words) >= n else runs(words, len(words))
            hit = self.known(hashes)
            if not hit.any():
                continue
            weights = {"plain": np.ones(len(hashes)), "weighted": self.weight(hashes)}
            held = {kind: np.concatenate([[0], np.cumsum(w * hit)]) for kind, w in weights.items()}
            totals: dict[str, np.ndarray] = {}

            def print_of(kind: str, start: np.ndarray, span: int) -> np.ndarray:
                if kind not in totals:
                    totals[kind] = np.concatenate([np.zeros((1, 64)), np.cumsum(signs(hashes) * weights[kind][:, None], axis=0)])  # noqa: B023
                return fingerprint(totals[kind][start + span] - totals[kind][start])  # noqa: B023

            for length in (x for x in self.lengths if min(self.n, x) == n):
                span = min(length - n + 1, len(hashes))
                pairs = set()
                for kind in KINDS:
                    start = np.flatnonzero(held[kind][span:] - held[kind][:-span] >= least * self.lightest[kind, length] - 1e-6)
                    if len(start):
                        found = self.candidates(kind, length, print_of(kind, start, span))
                        pairs.update(zip(start[found[:, 0]].tolist(), found[:, 1].tolist(), strict=True))
                for at, item in sorted(pairs):
                    inside = np.unique(hashes[at : at + span])
                    both = np.intersect1d(inside, self.sets[item], assume_unique=True)
                    if not len(both):
                        continue
                    shared = self.weight(both).sum()
                    union = self.weight(inside).sum() + self.weight(self.sets[item]).sum() - shared
                    similarity = round(float(shared / union), 9) if union > 0 else 0.0
                    rare = similarity >= least
                    if not rare:
                        similarity = round(len(both) / (len(inside) + len(self.sets[item]) - len(both)), 9)
                    if similarity >= least and (item not in best or (rare, similarity, -at) > (*best[item][:2], -best[item][2])):
                        kind = "weighted" if rare else "plain"
                        d = int(np.bitwise_count(print_of(kind, np.array([at]), span)[0] ^ self.prints[kind][item]))
                        best[item] = (rare, similarity, at, min(length, len(words)), d)
        return [(i, *v[1:]) for i, v in sorted(best.items())]


def _rarity(docs: DataFrame, items: Items) -> np.ndarray:
    """Weights of the items' shingles from all documents that hold them."""
    shipped = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shipped.value
        holds, rows = np.zeros(len(ready.vocabulary), np.int64), 0
        for batch in batches:
            for _, data, offsets in text_chunks(column_of(batch, "text")):
                words, before, _, _ = word_hashes(data, offsets, "alnum")
                rows += len(before) - 1
                for n in ready.sizes:
                    hashes = runs(words, n)
                    at = np.flatnonzero(ready.known(hashes)) if len(hashes) else np.zeros(0, int)
                    row = np.searchsorted(before, at, side="right") - 1
                    inside = at + n <= before[row + 1]
                    pair = np.unique(np.stack([row[inside], np.searchsorted(ready.vocabulary, hashes[at[inside]])], 1), axis=0)
                    holds += np.bincount(pair[:, 1], minlength=len(holds))
        at = np.flatnonzero(holds)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(holds[at], rows))], names=["at", "n"])

    found = docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    shipped.unpersist()
    total = float(found.loc[found["at"] < 0, "n"].sum())
    df = np.zeros(len(items.vocabulary))
    inside = found[found["at"] >= 0]
    df[inside["at"].to_numpy()] = inside["n"]
    return np.log((1 + total) / (1 + df)) / np.log(1 + total) if total > 0 else np.ones(len(df))


def with_contamination(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, least: float = 0.8, most_words: int = 200_000, result: str = "matches") -> DataFrame:
    """docs with one more column, the last one: array<struct<item_id, similarity, start_word, n_words, hamming>>, the best
    window for each benchmark item with a plain or weighted similarity of `least` or more. It is called `result`, with
    underscores behind it where docs has a column of that name; all columns of docs stay as they are.

    Words: letters and digits, A-Z lower-cased; shingles of n words, of all words for shorter items. Items are searched in
    blocks of about most_words words, one after the other: no more than one block is broadcast at a time, whatever the
    benchmark's size. Null, empty and wordless texts and items match nothing; equal items each match, and so do items that
    repeat an id. Ids of docs aren't read: null and repeated ones do no harm, and rows with equal texts have equal matches.
    An empty table gives no rows.
    """
    name = free_name(docs, result)
    words = F.size(F.split(F.col(item_text), r"\s+")) + 1
    plain = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text"))
    blocks = max(1, -(-int(items.agg(F.sum(words)).first()[0] or 0) // most_words))
    id_type = items.schema[item_id].dataType
    schema = f"array<struct<item_id:{id_type.simpleString()},similarity:double,start_word:int,n_words:int,hamming:int>>"
    text = F.col("`" + text_column.replace("`", "``") + "`").cast("string")
    if blocks == 1:
        search = _search(docs.select(text.alias("text")), plain, n, least, schema, id_type)
        return docs.withColumn(name, search[0](text) if search else F.expr(f"cast(array() as {schema})"))
    parts = []
    slim = docs.select(text.alias("text"))
    for block in range(blocks):
        search = _search(slim, plain.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block), n, least, schema, id_type)
        if search:
            hits = slim.select(F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), search[0](F.col("text")).alias("found"))
            parts.append(cut(hits.where(F.size("found") > 0).dropDuplicates(["t1", "t2"])))
            search[1].unpersist()
    one, two = free_name(docs, "__t1"), free_name(docs, "__t2")
    if not parts:
        return docs.withColumn(name, F.expr(f"cast(array() as {schema})"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # each text has one row a block at most
    found = cut(found.groupBy("t1", "t2").agg(F.flatten(F.collect_list("found")).alias("found")).select(F.col("t1").alias(one), F.col("t2").alias(two), F.array_sort("found").alias(name)))
    drop_cut(*parts)
    keyed = docs.withColumns({one: F.xxhash64(text), two: F.xxhash64(text, F.lit(1))})
    out = keyed.join(sized(found), [one, two], "left")
    return out.select(*all_columns(docs), F.coalesce(F.col(name), F.expr(f"cast(array() as {schema})")).alias(name))


def _search(texts: DataFrame, block: DataFrame, n: int, least: float, schema: str, id_type):
    """(a function of a text column, what it has broadcast) for the items of a block; None if it has no words."""
    rows = block.orderBy("item").collect()  # about most_words words
    ready = Items([r["item"] for r in rows], [r["text"] for r in rows], n)
    if not ready.sizes:
        return None
    ready.weights = np.maximum(_rarity(texts, ready), 1e-6)
    ready.index()
    part = texts.sparkSession.sparkContext.broadcast(ready)

    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = part.value
        for column in columns:
            out: list[list[dict]] = []
            for _, data, offsets in text_chunks(column):
                hashes, before, _, _ = word_hashes(data, offsets, "alnum")
                may = items.may_hold(hashes, before)
                for row in range(len(before) - 1):
                    mine = hashes[before[row] : before[row + 1]]
                    found = [(items.names[i], *rest) for i, *rest in items.search(mine, least)] if len(mine) and may[row] else []
                    out.append([dict(zip(("item_id", "similarity", "start_word", "n_words", "hamming"), x, strict=True)) for x in found])
            yield pa.array(out, arrow_type)

    arrow_type = pa.list_(pa.struct([("item_id", _arrow(id_type)), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("hamming", pa.int32())]))
    # called nondeterministic so that no filter on the column, nor one that explode implies, runs the search again
    return F.arrow_udf(search, schema).asNondeterministic(), part


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
