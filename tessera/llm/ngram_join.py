"""Jaccard self-join of word n-gram sets with adaptive multi-match prefixes (after AdaptJoin, Wang et al., 2012).

All sets follow one order of tokens, rare ones first. If two sets reach the threshold, their l-prefixes (n - least overlap
+ l tokens) share l tokens at least. A longer prefix with more matches asked reads more postings and verifies fewer pairs:
each set takes the l with the least estimated cost, and a pair obeys the greater l of the two. Order: the tokens' counts in
a hashed table of fixed size, then the hash (any order is right; this one keeps frequent tokens out of prefixes).

Equal sets are one vertex from the start, so exact copies cost one digest each. Tokens with long lists are cells of
linking.py: there one shared token is enough to be compared, without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, cut, distinct_by_row, drop_cut, long_lists, mix, shingle_hashes, sized, text_chunks, word_hashes
from .linking import FOLD, PARITY, PARITY_WORDS, SMALL_CELL, Index, bits_can_reach, bounded, components_of, folds, link_cells, may_link, named, parities, verified

#: Entries of the table of counts; 4 bytes each are broadcast, whatever the corpus.
COUNT_BITS = 21
MOST_MATCHES = 3


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    words, before, _, _ = word_hashes(data, offsets, kind)
    return distinct_by_row(*shingle_hashes(words, before, n))


def set_names(tokens: np.ndarray, after: np.ndarray) -> pa.Array:
    """16 bytes for each set, from two independent sums over its tokens; null for an empty one."""
    counts = np.diff(after)
    sums = []
    for salt in (np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ salt), out=total[1:])
        sums.append(mix(total[after[1:]] - total[after[:-1]] + counts.astype(np.uint64)))
    raw = np.stack(sums, 1).astype(">u8").tobytes()
    names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(counts), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pa.compute.if_else(pa.array(counts > 0), names, pa.scalar(None, pa.binary()))


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return -((-n * num) // den)


def _digests(frame: DataFrame, n: int, kind: str) -> DataFrame:
    """(id, t1, t2, n, v, p, fold) of each row, and (bucket, count) rows of the table of token counts: of each task those
    that stand out from its mean, which is all that an order of tokens needs."""
    fields = [("n", T.LongType()), ("v", T.BinaryType()), ("p", PARITY), ("fold", FOLD), ("bucket", T.LongType()), ("count", T.LongType())]
    schema = T.StructType([T.StructField("id", frame.schema["id"].dataType), T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())] + [T.StructField(*f) for f in fields])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.struct([(f"p{k}", pa.int64()) for k in range(PARITY_WORDS)]), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNT_BITS, np.int32)
        id_type = None
        for batch in batches:
            ids, t1, t2 = (column_of(batch, x) for x in ("id", "t1", "t2"))
            id_type = ids.type
            for row, data, offsets in text_chunks(column_of(batch, "text")):
                tokens, after = token_sets(data, offsets, n, kind)
                np.add.at(table, (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
                rows = len(after) - 1
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(row, rows), t1.slice(row, rows), t2.slice(row, rows), pa.array(np.diff(after)), set_names(tokens, after), parities(tokens, after), folds(tokens, after), none, none], names=schema.names)
        at = np.flatnonzero(table > 4 + 2 * table.mean())
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), id_type), *[pa.nulls(len(at), x) for x in arrow], pa.array(at), pa.array(table[at].astype(np.int64))], names=schema.names)

    return cut(frame.mapInArrow(run, schema))


def _count_table(both: DataFrame) -> np.ndarray:
    """The table of counts: 1 << COUNT_BITS rows at most come to the driver."""
    found = both.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    table[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def _postings(frame: DataFrame, counts, n: int, kind: str, num: int, den: int) -> DataFrame:
    """(token, v, n, level): level l for what the l-prefix adds to the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for _, data, offsets in text_chunks(column_of(batch, "text")):
                tokens, after = token_sets(data, offsets, n, kind)
                if not len(tokens):
                    continue
                size = np.diff(after)
                rows = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((tokens, table[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], rows))
                place = np.arange(len(tokens)) - after[rows]
                least = least_overlap(size, num, den)
                level = np.maximum(place - (size - least)[rows] + 1, 1)
                keep = (level <= np.minimum(MOST_MATCHES, least)[rows]) & (place < size[rows])
                names = set_names(tokens, after).take(pa.array(rows[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order][keep].view(np.int64)), names, pa.array(size[rows[keep]]), pa.array(level[keep].astype(np.int32))], names=["token", "v", "n", "level"])

    return frame.select("text").mapInArrow(run, "token long, v binary, n long, level int")


def sets_of(frame: DataFrame, wanted: DataFrame, n: int, kind: str) -> DataFrame:
    """(v, n, tokens) of the wanted sets (v, id): one text each is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(column_of(batch, "text")):
                tokens, after = token_sets(data, offsets, n, kind)
                yield pa.RecordBatch.from_arrays([set_names(tokens, after), pa.array(np.diff(after)), long_lists(tokens, after)], names=["v", "n", "tokens"])

    texts = frame.join(sized(wanted.select("id").distinct()), "id", "left_semi").select("text")
    return cut(texts.mapInArrow(run, "v binary, n long, tokens array<long>").join(sized(wanted.select("v")), "v", "left_semi").dropDuplicates(["v"]))


def _chosen_matches(shared: DataFrame) -> DataFrame:
    """(v, matches): for l from 1 to MOST_MATCHES the cost is the postings read, and for each l of them one verification,
    which takes as long as a fiftieth of the set's size in postings."""
    read = [F.sum(F.when(F.col("level") <= k, F.col("c") - 1).otherwise(0)).alias(f"r{k}") for k in range(1, MOST_MATCHES + 1)]
    most = F.least(F.lit(MOST_MATCHES), F.ceil(F.col("n") * F.col("num") / F.col("den")))
    sums = shared.groupBy("v", "n", "num", "den").agg(*read)
    cost = [F.when(most >= k, F.col(f"r{k}") * (1 + F.col("n") / 50 / k)).otherwise(F.lit(float("inf"))) for k in range(1, MOST_MATCHES + 1)]
    best = F.array_min(F.array(*[F.struct(c.alias("c"), F.lit(k).alias("k")) for k, c in enumerate(cost, 1)]))
    return sums.select("v", best["k"].alias("matches"))


def jaccard_classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = 5,
    num: int = 80,
    den: int = 100,
    kind: str = "space",
    small_cell: int = SMALL_CELL,
) -> DataFrame:
    """One row per row of docs: id, t1 and t2 (xxhash64 of the text with seeds 42 and 1), n_shingles long, component_id: the
    smallest id reachable by links, where sets of word n-grams link if their Jaccard similarity is num / den or more, and
    kept boolean: the row's (id, t1, t2) is the smallest of its component.

    Words: runs without ASCII white space (kind "space"), or of letters and digits ("alnum"), A-Z lower-cased. Null, empty
    and blank texts have an empty set and link with nothing; texts of fewer than n words are one shingle. Rows with a null
    id link with nothing, have a null component_id and are kept. Rows that repeat an id all take part, and each has a
    decision of its own; rows that repeat an id and a text have the same one. Other columns aren't read. An empty table
    gives no rows.
    """
    text = F.col("text")
    frame = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    frame = frame.select("id", F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), "text")
    both = _digests(frame, n, kind)
    rows = both.where("bucket is null").select("id", "t1", "t2", "n", "v", "p", "fold")
    counts = docs.sparkSession.sparkContext.broadcast(_count_table(both))

    postings = cut(_postings(frame.where("id is not null"), counts, n, kind, num, den))
    twice = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    met = cut(postings.join(twice, "token").groupBy("token", "v").agg(F.first("n").alias("n"), F.first("level").alias("level")))
    drop_cut(postings)
    counts.unpersist()
    lists = met.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    marks = cut(rows.where("v is not null and id is not null").groupBy("v").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("fold").alias("fold"), F.min("id").alias("id")))
    shared = cut(met.join(lists, "token").join(marks.select("v", "p"), "v").withColumns({"num": F.lit(num), "den": F.lit(den)}))
    drop_cut(met)
    index = Index(marks, lambda wanted: sets_of(frame, wanted, n, kind), num, den)

    hot = shared.where(F.col("c") > small_cell).select(F.col("token").alias("cell"), "v", "n", "p")
    links, names, across = link_cells(hot.join(hot.groupBy("v").agg(F.count("*").alias("central")), "v"), index, small_cell)

    cold = shared.where(F.col("c") <= small_cell)
    cold = cut(named(cold.join(_chosen_matches(cold), "v"), names).select("token", "v", "n", "p", "cv", "level", "matches"))
    drop_cut(shared)
    probe = cold.where("level <= matches").select("token", F.col("v").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("cv").alias("ca"), F.col("matches").alias("ma"))
    second = cold.select("token", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("cv").alias("cb"), F.col("matches").alias("mb"), F.col("level").alias("lb"))
    below = (F.col("lb") <= F.col("ma")) & ((F.col("mb") < F.col("ma")) | ((F.col("mb") == F.col("ma")) & (F.col("b") < F.col("a"))))
    able = (F.col("ca") != F.col("cb")) & may_link(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), num, den)
    pairs = probe.join(second, "token").where(below & able)
    pairs = pairs.groupBy("a", "b", "ma").agg(F.count("*").alias("m")).where("m >= ma").select("a", "b")
    pairs = bounded(pairs, index).where(bits_can_reach(F.col("na"), F.col("nb"), F.col("bits"), num, den))
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(across).distinct())
    drop_cut(cold, across)
    last = verified(pairs, index)
    drop_cut(pairs, marks)
    joined = components_of([*links, last.select("a", "b")])

    known = rows.join(joined.select(F.col("vertex").alias("v"), "component"), "v", "left")
    known = known.withColumn("root", F.coalesce("component", "v")).select("id", "t1", "t2", "n", "root")
    least = known.where("root is not null and id is not null").groupBy("root").agg(F.min(F.struct("id", "t1", "t2")).alias("least"))
    out = known.join(least, "root", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least.id", "id"))
    kept = F.col("id").isNull() | F.col("least").isNull() | (F.col("least") == F.struct("id", "t1", "t2"))
    return out.select("id", "t1", "t2", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", **how) -> DataFrame:
    """jaccard_classes(docs, id_column, ...) as (the id column, n_shingles, component_id)."""
    return jaccard_classes(docs, id_column, **how).select(F.col("id").alias(id_column), "n_shingles", "component_id")
