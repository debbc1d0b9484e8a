"""Groups of rows that all meet each other, without a copy of either table on disk.

A group's rows are packed into one value. Each task takes a few groups of one table, reads those of the other one by one and
keeps what is best so far: shuffles write each row once, however many groups it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import kept, released

#: Rows of an Arrow batch that a group is packed from.
BATCH = 10_000
#: Groups that a task reads one by one, about; tasks for each core, at least, as far as there are groups.
READ, TASKS = 64, 4


def packed(df: DataFrame, group: Column) -> DataFrame:
    """(number, pack): the rows of df of each group, as one value; written."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows, sink = rows.drop_columns(["number"]).combine_chunks(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        return pa.table({"number": pa.array([key[0].as_py()], pa.int32()), "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return kept(df.withColumn("number", group.cast("int")).groupBy("number").applyInArrow(pack, "number int, pack binary"), "packs", BATCH)


def unpacked(pack: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(pack.as_buffer()).read_all()


def best_rows(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each row, then the smallest ids; rows in order."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def met(asked: DataFrame, asked_groups: int, held: DataFrame, held_groups: int, best: Callable, k: int, schema: str, name: str) -> DataFrame:
    """(query_id, id, score) of the k best of each row of asked, written, for each task that met it. Both tables come packed, in about
    so many groups, and go. best(number, rows of a group of asked, rows of a group of held) finds (row, id, score) in numpy arrays."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    parts = min(held_groups, max(-(-TASKS * cores // asked_groups), -(-held_groups // READ)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple] = {}  # only what is best so far: a task can have several groups of asked
        for batch in batches:
            for number, mine, other in zip(*batch.columns, strict=True):
                number, rows = number.as_py(), unpacked(mine)
                new = best(number, rows, unpacked(other))
                queries, so_far = groups.get(number) or (rows.column("query_id").take(np.arange(len(rows))).combine_chunks(), [x[:0] for x in new])
                new = [np.concatenate(x) for x in zip(so_far, new, strict=True)]
                few = best_rows(*new, k)
                groups[number] = queries, [x[few] for x in new]
        for queries, (row, ids, score) in groups.values():
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(row)), pa.array(ids), pa.array(score)], names=["query_id", "id", "score"])

    queries = asked.select("number", F.col("pack").alias("asked")).repartition(asked_groups)
    pairs = held.select(F.col("pack").alias("held")).repartition(parts).crossJoin(queries.hint("shuffle_replicate_nl"))  # the right side is held, the left one read
    out = kept(pairs.select("number", "asked", "held").mapInArrow(found, schema), name, batch=1)
    released(asked, held)
    return out
