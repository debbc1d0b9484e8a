"""Toxicity by two class-conditional Kneser-Ney models that share their backoff counts.

The contexts that are counted are texts: n_c(h, w) is the number of different texts of class c in which w follows h, n_c(w)
that of texts with w, so a text copied a thousand times counts once. D discounts every count of words, D' every count of
pairs, and what discounts take from the rare goes to the next lower order:

    p_c(w | h) = max(n_c(h, w) - D', 0) / n_c(h, .) + sum_v min(n_c(h, v), D') / n_c(h, .) * p_c(w)
    p_c(w)     = max(n_c(w) - D, 0) / n_c(.)        + sum_v min(n_c(v), D) / n_c(.)        * q(w)
    q(w)       = (n(w) + 1) / (n(.) + words + 1)

q is one distribution for both classes, from n(w), the number of different texts of the whole corpus with w. Each of them
sums to 1. A word or pair that neither class has seen more often than its discount gives the same ratio whatever it is, so
only the others need be shipped; none is cut away.

Evidence: log-likelihood ratios divided by their length, of the whole text and of its best passages of each of `passages`
words, under the pair model and under the word model. A logistic curve over these, fitted on training rows that gave no
counts, turns them into a score; the discount is the one of DISCOUNTS whose curve fits those rows best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, all_columns, column_of, cut, drop_cut, free_name, mix, sized, text_chunks, word_hashes

#: Discounts of word counts that are tried; pairs, which are noisier, have PAIR_FACTOR times as much.
DISCOUNTS = (1, 2, 4, 8, 16, 32)
PAIR_FACTOR = 4
#: Values (rows times columns) of counts that a task holds before it adds equal rows up and, if they stay as many, hands them on.
HELD_VALUES = 1 << 20


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(BASE) + w)


def heads(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The word before each word; 0 before a text's first."""
    out = np.roll(words, 1)
    out[before[:-1][np.diff(before) > 0]] = 0
    return out


def _distinct(rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Places of the first of equal (row, keys)."""
    order = np.lexsort((*keys, rows))
    new = np.ones(len(order), bool)
    new[1:] = rows[order][1:] != rows[order][:-1]
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new]


def _added(parts: list[tuple[np.ndarray, ...]], keys: int) -> list[tuple[np.ndarray, ...]]:
    """Parts of (keys..., counts...) as one with equal keys added up."""
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort(columns[:keys])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
    first = np.flatnonzero(new)
    return [(*[c[first] for c in columns[:keys]], *[np.add.reduceat(c, first) if len(first) else c for c in columns[keys:]])]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of_pair, h, w, n0, n1): in how many texts of each class a pair stands, and with of_pair 0 a word."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        labels = column_of(batch, "label").to_numpy().astype(np.int64)
        for row, data, offsets in text_chunks(column_of(batch, "text")):
            words, before, _, _ = word_hashes(data, offsets, "alnum")
            if not len(words):
                continue
            rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
            y = labels[row + rows]
            h = heads(words, before)
            for of_pair, at in ((0, _distinct(rows, words)), (1, _distinct(rows, h, words))):
                held.append((np.full(len(at), of_pair, np.int64), h[at].view(np.int64) * of_pair, words[at].view(np.int64), 1 - y[at], y[at]))
        if sum(len(x[0]) for x in held) * 5 > HELD_VALUES:
            held = _added(held, 3)
            if len(held[0][0]) * 10 > HELD_VALUES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["of_pair", "h", "w", "n0", "n1"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(held, 3)[0]], names=["of_pair", "h", "w", "n0", "n1"])


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): in how many texts each word stands."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for _, data, offsets in text_chunks(column_of(batch, "text")):
            words, before, _, _ = word_hashes(data, offsets, "alnum")
            rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
            at = _distinct(rows, words)
            held.append((words[at].view(np.int64), np.ones(len(at), np.int64)))
        if sum(len(x[0]) for x in held) * 2 > HELD_VALUES:
            held = _added(held, 1)
            if len(held[0][0]) * 4 > HELD_VALUES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["w", "n"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(held, 1)[0]], names=["w", "n"])


class Counts:
    """What the two models are worked out from: words and pairs as sorted hashes with their counts in both classes, q of each
    word, the total of word counts and for each discount what it takes from them; for heads of pairs the same."""

    def __init__(self, words, word_n, q, total, taken, pairs, pair_n, heads, head_total, head_taken, passages):
        self.words, self.word_n, self.q, self.total, self.taken = words, word_n, q, total, taken
        self.pairs, self.pair_n = pairs, pair_n
        self.heads, self.head_total, self.head_taken = heads, head_total, head_taken
        self.passages = passages

    def ratios(self, words: np.ndarray, before: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """log p_1 - log p_0 of each place of a text under the pair model and under the word model, for DISCOUNTS[d]."""
        at, known = _places(self.words, words)
        q = np.where(known, self.q[at], 1.0) if len(self.words) else np.ones(len(words))  # cancels where only q speaks
        h = heads(words, before)
        pair, pair_known = _places(self.pairs, pair_hash(h, words))
        head, head_known = _places(self.heads, h)
        of_pair, of_word = [], []
        for c in (0, 1):
            own = np.where(known, np.maximum(self.word_n[c][at] - DISCOUNTS[d], 0), 0) if len(self.words) else 0
            word = own / self.total[c] + self.taken[c][d] / self.total[c] * q
            p = word
            if len(self.heads):
                more = np.where(pair_known, np.maximum(self.pair_n[c][pair] - PAIR_FACTOR * DISCOUNTS[d], 0), 0) if len(self.pairs) else 0
                n = self.head_total[c][head]
                p = np.where(head_known & (n > 0), (more + self.head_taken[c][d][head] * word) / np.maximum(n, 1), word)
            of_pair.append(p)
            of_word.append(word)
        return np.log(of_pair[1] / of_pair[0]), np.log(of_word[1] / of_word[0])

    def features(self, data: np.ndarray, offsets: np.ndarray, d: int) -> np.ndarray:
        """For each text the means of the ratios over the whole of it and over its best passages; 0 without words."""
        words, before, _, _ = word_hashes(data, offsets, "alnum")
        out = np.zeros((len(offsets) - 1, 2 * (1 + len(self.passages))))
        some = np.flatnonzero(np.diff(before))
        if not len(some):
            return out
        begin, size = before[some], np.diff(before)[some]
        rows = np.repeat(np.arange(len(some)), size)
        stop = (begin + size)[rows]
        column = 0
        for ratio in self.ratios(words, before, d):
            total = np.concatenate([[0.0], np.cumsum(ratio)])
            out[some, column] = (total[begin + size] - total[begin]) / size
            for k, length in enumerate(self.passages, 1):
                span = np.minimum(length, size[rows])
                end = np.arange(len(words)) + span
                mean = np.where(end <= stop, (total[np.minimum(end, len(words))] - total[:-1]) / span, -np.inf)
                out[some, column + k] = np.maximum.reduceat(mean, begin)
            column += 1 + len(self.passages)
        return out


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted key or some place, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _sampled(slim: DataFrame, chosen: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Texts with their labels: of each class about most_rows rows and most_bytes bytes (by the mean size of all texts), thinned
    by a hash of the id. Only ids are thinned before the join, so no text moves: the sample of ids is bounded and broadcast."""
    size = slim.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    keep = F.lit(False)
    for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect():  # two classes
        share = min(1.0, most_rows / r["n"], most_bytes / (r["n"] * size))
        keep = keep | ((F.col("label") == r["label"]) & (F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return slim.join(F.broadcast(chosen.where(keep)), "id").where("text is not null")  # about 2 * most_rows rows of 12 bytes


def _taken(n: str, factor: int) -> list[Column]:
    """Sums of what each discount takes from the counts n0 and n1."""
    return [F.sum(F.least(f"n{c}", F.lit(factor * d))).alias(f"{n}{c}_{k}") for c in (0, 1) for k, d in enumerate(DISCOUNTS)]


def counted(slim: DataFrame, taught: DataFrame, passages: tuple[int, ...]) -> Counts | None:
    """Counts of taught(text, label), backed by those of the corpus slim(id, text); None if a class has no words."""
    once = taught.groupBy(F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "label").agg(F.first("text").alias("text"))
    found = once.select("text", "label").mapInArrow(_grams, "of_pair long, h long, w long, n0 long, n1 long")
    grams = cut(found.groupBy("of_pair", "h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    words, pairs = grams.where("of_pair = 0"), grams.where("of_pair = 1")
    sums = words.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *_taken("d", 1)).first()
    if not sums["n0"] or not sums["n1"]:
        drop_cut(grams)
        return None

    copies = cut(slim.where("text is not null").groupBy(F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")).agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").select("t1", "t2", "least"))
    keyed = slim.select("id", "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    different = keyed.join(sized(copies), ["t1", "t2"], "left").where(F.col("least").isNull() | (F.col("id") == F.col("least"))).select("text")
    corpus = cut(different.mapInArrow(_texts_with, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    drop_cut(copies)
    whole = corpus.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()

    above = F.greatest("n0", "n1")
    kept = words.where(above > DISCOUNTS[0]).select("w", "n0", "n1").join(corpus, "w", "left").toArrow()
    least_pair = PAIR_FACTOR * DISCOUNTS[0]
    often = pairs.where(above > least_pair).select("h", "w", "n0", "n1").toArrow()
    after = pairs.groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max(above).alias("most"), *_taken("d", PAIR_FACTOR)).where(F.col("most") > least_pair).toArrow()
    drop_cut(grams, corpus)

    w, order = _sorted(kept.column("w").to_numpy())
    q = (kept.column("n").fill_null(0).to_numpy()[order] + 1) / ((whole["n"] or 0) + whole["words"] + 1)
    of = lambda table, name, at: [table.column(f"{name}{c}").to_numpy()[at].astype(np.int32) for c in (0, 1)]
    pair = pair_hash(often.column("h").to_numpy().view(np.uint64), often.column("w").to_numpy().view(np.uint64))
    pair, pair_order = _sorted(pair.view(np.int64))
    head, head_order = _sorted(after.column("h").to_numpy())
    head_taken = [[after.column(f"d{c}_{k}").to_numpy()[head_order].astype(np.int32) for k in range(len(DISCOUNTS))] for c in (0, 1)]
    totals = [float(sums["n0"]), float(sums["n1"])]
    taken = [[float(sums[f"d{c}_{k}"]) for k in range(len(DISCOUNTS))] for c in (0, 1)]
    return Counts(w, of(kept, "n", order), q, totals, taken, pair, of(often, "n", pair_order), head, of(after, "n", head_order), head_taken, passages)


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values as unsigned ones in order, and that order."""
    order = np.argsort(values.view(np.uint64), kind="stable")
    return values.view(np.uint64)[order], order


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    result: str = "toxicity",
    most_rows: int = 10_000,
    most_bytes: int = 32_000_000,
    passages: tuple[int, ...] = (1, 4),
) -> DataFrame:
    """docs with one more column, struct<score double (0 to 1), evidence double (log odds)>. It is the last one and called
    `result`, with underscores behind it where docs has a column of that name; all columns of docs stay as they are.

    labels(id_column, label_column): rows with a null id or label count for nothing; of several rows for an id the greatest
    label holds. train: a condition on the id column; labels of other rows are never read. The classifier's sample: about
    most_rows rows or most_bytes of labelled text of each class, whichever is less, by a hash of the id, which also bounds
    what is shipped; a fifth of it calibrates, the rest gives counts. Of rows that repeat an id or a text each is scored; equal texts have equal scores.
    Null, empty and wordless texts have features of 0. Without training rows with words of both classes every score is the
    share of toxic ones (0 without any). An empty table gives no rows.
    """
    spark = docs.sparkSession
    name = free_name(docs, result)
    chosen = labels.where(train & F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = cut(_sampled(slim, chosen, most_rows, most_bytes))
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(5)) == 0
    counts = counted(slim, rows.where(~calibrates), passages)
    if counts is None:
        share = float(chosen.agg(F.avg("label")).first()[0] or 0.0)
        drop_cut(rows)
        return docs.withColumn(name, F.struct(F.lit(share).alias("score"), F.lit(0.0).alias("evidence")))
    shipped = spark.sparkContext.broadcast(counts)

    def calibration(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shipped.value
        for batch in batches:
            y = column_of(batch, "label").to_numpy().astype(np.int32)
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                for d in range(len(DISCOUNTS)):
                    x = ready.features(data, offsets, d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), pa.array(y[row : row + len(x)]), pa.array(list(x), pa.list_(pa.float64()))], names=["d", "y", "x"])

    seen = rows.where(calibrates).select("text", "label").mapInArrow(calibration, "d int, y int, x array<double>").toArrow()  # a fifth of the sample
    drop_cut(rows)
    d, weights = fitted(seen.column("d").to_numpy(), seen.column("y").to_numpy().astype(float), np.array(seen.column("x").to_pylist()).reshape(len(seen), -1), len(passages))

    def evidence(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = shipped.value
        for column in texts:
            parts = [ready.features(data, offsets, d) @ weights[:-1] + weights[-1] for _, data, offsets in text_chunks(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    inner = free_name(docs, "evidence")
    out = docs.withColumn(inner, F.arrow_udf(evidence, T.DoubleType())(F.col(text_column).cast("string")))
    x = F.col(inner)
    return out.select(*all_columns(docs), F.struct(F.round(1 / (1 + F.exp(-x)), 9).alias("score"), x.alias("evidence")).alias(name))


def fitted(d: np.ndarray, y: np.ndarray, x: np.ndarray, passages: int) -> tuple[int, np.ndarray]:
    """(index of the discount whose logistic curve fits best, the curve's weights with the intercept last)."""
    if len(set(y)) < 2:  # nothing to fit: mean ratios of the best passages, a neutral curve
        weights = np.zeros(2 * (1 + passages) + 1)
        weights[1] = weights[-1] = 4.0
        return 0, weights * np.where(np.arange(len(weights)) == len(weights) - 1, -1, 1)
    best = None
    for k in sorted(set(d.tolist())):
        weights, loss = fit_logistic(x[d == k], y[d == k])
        if best is None or loss < best[0]:
            best = loss, k, weights
    return best[1], best[2]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(weights with the intercept last, mean loss) of a logistic curve over standardised columns; a small ridge keeps separable
    rows finite."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    design = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    penalty = np.diag([ridge * len(x)] * x.shape[1] + [1e-9 * len(x)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -35, 35)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + penalty, design.T @ (y - p) - penalty @ weights)
        weights = weights + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ weights, -35, 35))), 1e-12, 1 - 1e-12)
    slope = weights[:-1] / spread
    return np.append(slope, weights[-1] - slope @ centre), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
