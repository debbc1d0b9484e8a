"""Passages that stand in several places, inside lines of any length: what paragraphs.py, which compares whole lines, can't see.

A passage is a maximal run of words each of whose windows of `words` words stands in two places.

1. Each window has a MinHash, the least hash of its runs of words // 2 words; equal windows have equal ones, and the places
   that are least in some window are few. Only texts with a MinHash that occurs again are read further.
2. Consecutive windows of one MinHash are a segment. Equal segments are one, with a count; one that occurs twice is repeated as
   a whole. Windows are compared one by one only where a MinHash has different segments, and once for each of these.
3. What is repeated goes back to the texts and is merged; passages that share a window are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, column_of, cut, drop_cut, every_span_hash, long_lists, mix, powers, sized, text_chunks, word_hashes
from .graph import connected_components
from .suffix_dedup import HOT_ROWS, _repeated, sliding_least


def window_minima(words: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the runs of length // 2 words, MinHash of each window of `length` words, the window's own hash, whether it
    lies in one row), all by the word they start at."""
    if len(words) < length:
        none = np.zeros(0, np.uint64)
        return none, none, none, np.zeros(0, bool)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words), BASE, "up"))])
    runs = every_span_hash(prefix, length // 2)
    least = sliding_least(runs, length - length // 2 + 1)
    ends = np.repeat(before[1:], np.diff(before))
    return runs, least, every_span_hash(prefix, length), np.arange(len(least)) + length <= ends[: len(least)]


def least_places(runs: np.ndarray, least: np.ndarray, inside: np.ndarray, length: int) -> np.ndarray:
    """Words at which a run starts that is the least of some window."""
    width = length - length // 2 + 1
    none = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    highest = sliding_least(np.concatenate([none, np.where(inside, ~least, none[0]), none]), width)
    return np.flatnonzero((~highest == runs) & (highest != none[0]))


def _joined(frame: DataFrame, few: DataFrame) -> DataFrame:
    """frame joined with few(w, found, ...), where found is at least how many rows of frame have w; a w of more than HOT_ROWS
    rows is joined without a shuffle by w. few is written."""
    hot = few.where(F.col("found") > HOT_ROWS)
    if hot.isEmpty():
        return frame.join(few, "w")
    hot = sized(hot)  # one for each HOT_ROWS rows at most
    left = frame.join(hot.select("w"), "w", "left_anti")
    return frame.join(hot, "w").unionByName(left.join(few.where(F.col("found") <= HOT_ROWS), "w"))


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 50) -> DataFrame:
    """One row per passage, with the columns of duplicate_paragraphs and class_start: paragraph is the line in which the passage
    starts (it may cross lines), class_id, class_paragraph and class_start name the class's passage of least id and start,
    which stays. A passage that repeats within itself only has a class_size of 1.

    Words are letters and digits, A-Z lower-cased; null and empty texts have none. Rows with a null id are left out, rows that
    repeat an id and a text count as two places, but give their passages once. Other columns aren't read. An empty table
    gives no rows.
    """
    if words < 2:
        raise ValueError("a passage has two words at least")
    frame = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null")
    kind = frame.schema["id"].dataType

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column_of(batch, "id")
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                hashes, before, _, _ = word_hashes(data, offsets, "alnum")
                runs, least, _, inside = window_minima(hashes, before, words)
                if inside.any():
                    at = least_places(runs, least, inside, words)
                    owner = np.searchsorted(before, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(runs[at].view(np.int64)), ids.take(pa.array(owner + row))], names=["h", "id"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, wanted = (column_of(batch, x) for x in ("id", "t", "wanted"))
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                hashes, before, starts, ends = word_hashes(data, offsets, "alnum")
                _, least, own, inside = window_minima(hashes, before, words)
                asked = wanted.slice(row, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(inside & np.isin(least, asked))
                if not len(at):
                    continue
                owner = np.searchsorted(before, at, side="right") - 1
                breaks = np.flatnonzero(data == 10)
                line = np.searchsorted(breaks, starts[at]) - np.searchsorted(breaks, offsets[owner])
                new = np.ones(len(at), bool)
                new[1:] = (np.diff(at) > 1) | (np.diff(owner) > 0) | (least[at[1:]] != least[at[:-1]])
                first = np.flatnonzero(new)
                after = np.append(first, len(at))
                size = np.diff(after)
                place = np.arange(len(at)) - np.repeat(first, size)
                content = np.add.reduceat(mix(own[at] ^ mix(place.astype(np.uint64))), first)
                take = pa.array(owner[first] + row)
                plain = [least[at[first]].view(np.int64), content.view(np.int64), (at - before[owner])[first], size]
                lists = [own[at], line, starts[at] - offsets[owner], ends[at + words - 1] - offsets[owner]]
                yield pa.RecordBatch.from_arrays([ids.take(take), t.take(take), *map(pa.array, plain), *(long_lists(x, after) for x in lists)], names=schema.names)

    long = T.LongType()
    found = cut(frame.mapInArrow(places, T.StructType([T.StructField("h", long), T.StructField("id", kind)])))
    met = cut(_repeated(found).groupBy("id").agg(F.collect_set("h").alias("wanted")))
    drop_cut(found)
    asked = frame.join(met, "id").select("id", "text", F.xxhash64("text").alias("t"), "wanted")
    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(x, long) for x in ("t", "h", "c", "k", "n")] + [T.StructField(x, T.ArrayType(long)) for x in ("windows", "lines", "starts", "ends")])
    seen = cut(asked.mapInArrow(segments, schema))
    drop_cut(met)

    marks = cut(seen.groupBy("h", "c").agg(F.count("*").alias("places")))
    mixed = marks.groupBy("h").agg(F.count("*").alias("different"), F.max("places").alias("most")).where("different > 1 or most = 1").select("h")
    one = seen.select("h", "c", "windows").join(mixed, "h", "left_semi").groupBy("h", "c").agg(F.first("windows").alias("windows"))
    each = cut(one.join(marks, ["h", "c"]).select("h", "c", "places", F.posexplode("windows").alias("j", "w")))
    again = cut(each.groupBy("w").agg(F.count("*").alias("found")).where("found > 1"))
    in_segment = Window.partitionBy("h", "c").orderBy("j")  # numbers in a row have the same distance to their rank
    piece = F.xxhash64("h", "c", (F.col("j") - F.row_number().over(in_segment)).cast("long"))
    found = each.where("places > 1").unionByName(_joined(each.where("places = 1"), again).select(each.columns))
    twice = cut(found.withColumn("piece", piece))
    drop_cut(each, again)
    parts = twice.where("places = 1").groupBy("h", "c", "piece").agg(F.min("j").alias("x"), F.max("j").alias("y"))
    whole = marks.where("places > 1").select("h", "c", F.xxhash64("h", "c", F.lit(-1).cast("long")).alias("piece"))
    ends = [F.col("lines")[0].alias("paragraph"), F.col("starts")[0].alias("start"), F.element_at("ends", -1).alias("end")]
    put = seen.select("id", "t", "h", "c", F.col("k").alias("a"), (F.col("k") + F.col("n") - 1).alias("b"), *ends).join(whole, ["h", "c"]).drop("h", "c")
    ends = [F.expr("lines[x]").alias("paragraph"), F.expr("starts[x]").alias("start"), F.expr("ends[y]").alias("end")]
    put = put.unionByName(seen.join(parts, ["h", "c"]).select("id", "t", (F.col("k") + F.col("x")).alias("a"), (F.col("k") + F.col("y")).alias("b"), *ends, "piece"))

    in_text = Window.partitionBy("id", "t").orderBy("a", "b")
    gap = F.col("a") > F.max("b").over(in_text.rowsBetween(Window.unboundedPreceding, -1)) + 1
    placed = cut(put.withColumn("gap", gap).withColumn("run", F.xxhash64("id", "t", F.count_if("gap").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))).drop("gap"))
    drop_cut(seen, marks)
    runs = placed.groupBy("run").agg(F.first("id").alias("id"), F.min(F.struct("start", "paragraph")).alias("first"), F.max("end").alias("end"), (F.max("b") - F.min("a") + words).alias("n_words"))
    least = cut(placed.groupBy("piece").agg(F.min("run").alias("low")))
    links = placed.join(least, "piece").select(F.col("run").alias("a"), F.col("low").alias("b"))
    first = cut(twice.groupBy("w").agg(F.min("piece").alias("other"), F.count("*").alias("found")).where("found > 1"))
    shared = _joined(twice.select("w", "piece"), first).where("piece <> other").select("piece", "other").distinct()
    across = shared.join(least.withColumnRenamed("low", "a"), "piece").join(least.select(F.col("piece").alias("other"), F.col("low").alias("b")), "other").select("a", "b")
    links = connected_components(links.unionByName(across))
    drop_cut(twice, least, first)
    known = runs.join(links.select(F.col("vertex").alias("run"), "component"), "run", "left").withColumn("root", F.coalesce("component", "run"))
    classes = known.groupBy("root").agg(F.count("*").alias("class_size"), F.min(F.struct("id", "first.start", "first.paragraph")).alias("kept"))
    return known.join(classes, "root").select(
        F.col("id").alias(id_column),
        F.col("first.paragraph").cast("int").alias("paragraph"),
        F.col("first.start").alias("start"),
        (F.col("end") - F.col("first.start")).alias("n_bytes"),
        "n_words",
        F.col("kept.id").alias("class_id"),
        F.col("kept.paragraph").cast("int").alias("class_paragraph"),
        "class_size",
        ((F.col("kept.id") != F.col("id")) | (F.col("kept.start") != F.col("first.start"))).alias("removed"),
        F.col("kept.start").alias("class_start"),
    )
