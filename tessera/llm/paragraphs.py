"""Near-duplicate paragraphs: MinHash banding for candidates, exact Jaccard for links, one paragraph kept of each component.

A paragraph is a line. Its set: the distinct runs of n words. Bands are tuned so that two paragraphs at the threshold meet
in one band at least with the given recall; pairs that meet are compared exactly. Equal sets are one vertex from the start.
Bands with very many members go through leaders (linking.py) and not through all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, cut, distinct_by_row, drop_cut, long_lists, mix, shingle_hashes, sized, text_chunks, word_hashes
from .linking import FOLD, PARITY, SMALL_CELL, Index, components_of, folds, link_cells, parities, verified
from .ngram_join import set_names


#: Members of a large band bucket that all others are compared with before any of its pairs are.
LEADERS = 16


def tuned_bands(threshold: float, recall: float = 0.9995, most_bands: int = 8) -> tuple[int, int]:
    """(bands, rows of a band): of all that reach the recall at the threshold with most_bands bands at most, the most
    selective. A band costs a shuffled row a paragraph, so the bands are bounded first."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1) if threshold < 1 else (1, 1)
    for rows in range(2, 12):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands <= most_bands:
            best = (bands, rows)
    return best


def band_keys(tokens: np.ndarray, after: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each (set, band); sets must not be empty."""
    multipliers = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    keys = np.empty((len(after) - 1, bands), np.uint64)
    for band in range(bands):
        key = np.full(len(after) - 1, band + 1, np.uint64)
        for r in range(rows):
            key = mix(key ^ np.minimum.reduceat(mix(tokens * multipliers[band * rows + r]), after[:-1]))
        keys[:, band] = key
    return keys


def paragraph_sets(data: np.ndarray, offsets: np.ndarray, n: int, least_words: int):
    """For each line with least_words words: (row, number of the line in it, start in it, bytes without the line's end,
    words), and their sets as (tokens, after)."""
    lines = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    lines = lines if len(lines) > 1 else np.array([0, 0])
    words, before, _, _ = word_hashes(data, lines, "alnum")
    count = np.diff(before)
    owner = np.minimum(np.searchsorted(offsets, lines[:-1], side="right") - 1, len(offsets) - 2)  # nothing but empty rows: the last
    first = np.searchsorted(lines[:-1], offsets[:-1])
    keep = np.flatnonzero(count >= max(least_words, 1))
    shingles, after = shingle_hashes(words, before, n)
    tokens, ends = distinct_by_row(shingles, after)
    size = np.diff(ends)
    mine = np.repeat(np.isin(np.arange(len(size)), keep), size)
    has_end = (data[np.maximum(lines[1:] - 1, 0)] == 10).astype(np.int64) if len(data) else np.zeros(len(lines) - 1, np.int64)
    number = np.arange(len(owner)) - first[owner]
    meta = (owner[keep], number[keep], (lines[:-1] - offsets[owner])[keep], (np.diff(lines) - has_end)[keep], count[keep])
    return meta, tokens[mine], np.concatenate([[0], np.cumsum(size[keep])])


def duplicate_paragraphs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = 5,
    num: int = 80,
    den: int = 100,
    least_words: int = 15,
    recall: float = 0.9995,
    small_cell: int = SMALL_CELL,
) -> DataFrame:
    """One row per paragraph that has a near duplicate: the id column, paragraph int (number of the line from 0), start and
    n_bytes long (UTF-8 bytes from the text's start), n_words long, class_id and class_paragraph (the component's least id
    and line, which stay), class_size long, removed boolean.

    Paragraphs of fewer than least_words words (letters and digits, A-Z lower-cased) are never removed. Null and empty texts
    have no paragraphs. Rows with a null id are left out: nobody could name their paragraphs. Rows that repeat an id and a
    line share one decision. Other columns aren't read. An empty table gives no rows.
    """
    bands, rows_of_band = tuned_bands(num / den, recall)
    frame = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    schema = T.StructType(
        [T.StructField("id", frame.schema["id"].dataType), T.StructField("paragraph", T.IntegerType())]
        + [T.StructField(x, T.LongType()) for x in ("start", "n_bytes", "n_words", "n")]
        + [T.StructField("v", T.BinaryType()), T.StructField("p", PARITY), T.StructField("fold", FOLD), T.StructField("keys", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "id")
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                (owner, number, start, size, words), tokens, after = paragraph_sets(data, offsets, n, least_words)
                if len(owner):
                    keys = band_keys(tokens, after, bands, rows_of_band)
                    columns = [ids.take(pa.array(owner + row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(words), pa.array(np.diff(after)), set_names(tokens, after), parities(tokens, after), folds(tokens, after)]
                    yield pa.RecordBatch.from_arrays([*columns, long_lists(keys.reshape(-1), np.arange(len(keys) + 1) * bands)], names=schema.names)

    found = cut(frame.mapInArrow(run, schema))
    met = found.select(F.explode("keys").alias("cell"), "v")
    twice = met.groupBy("cell").agg(F.count("*").alias("c")).where("c > 1").select("cell")
    marks = cut(found.groupBy("v").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("fold").alias("fold"), F.min("id").alias("id")))
    cells = cut(met.join(twice, "cell").select("cell", "v").distinct().join(marks.select("v", "n", "p"), "v").withColumn("central", F.lit(0)))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(column_of(batch, "text")):
                _, tokens, after = paragraph_sets(data, offsets, n, least_words)
                if len(after) > 1:
                    yield pa.RecordBatch.from_arrays([set_names(tokens, after), pa.array(np.diff(after)), long_lists(tokens, after)], names=["v", "n", "tokens"])

    def fetch(wanted: DataFrame) -> DataFrame:
        texts = frame.join(sized(wanted.select("id").distinct()), "id", "left_semi").select("text")
        return cut(texts.mapInArrow(tokens_of, "v binary, n long, tokens array<long>").join(sized(wanted.select("v")), "v", "left_semi").dropDuplicates(["v"]))

    index = Index(marks, fetch, num, den)
    links, _, across = link_cells(cells, index, small_cell, leaders_a_cell=LEADERS)
    drop_cut(cells)
    last = verified(across, index)
    drop_cut(across, marks)
    joined = components_of([*links, last.select("a", "b")])

    known = found.drop("keys", "n", "p", "fold").join(joined.select(F.col("vertex").alias("v"), "component"), "v", "left").withColumn("root", F.coalesce("component", "v"))
    classes = known.groupBy("root").agg(F.count("*").alias("class_size"), F.min(F.struct("id", "paragraph", "start")).alias("kept")).where("class_size > 1")
    out = known.join(classes, "root")
    return out.select(
        F.col("id").alias(id_column),
        "paragraph",
        "start",
        "n_bytes",
        "n_words",
        F.col("kept.id").alias("class_id"),
        F.col("kept.paragraph").alias("class_paragraph"),
        "class_size",
        ((F.col("kept.id") != F.col("id")) | (F.col("kept.paragraph") != F.col("paragraph"))).alias("removed"),
    )
