"""Running counts, sums and digests along an order, for keys of any size.

A window would put all rows of a key into one task. Here rows are dealt by ranges of (key, order), each task folds what it
holds, and what a task hands on to the next is a row a task: the state at its last row. A second pass adds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK, column_of, cut, powers

FULL = int(MASK)
#: A lane of this kind keeps the key's first value.
FIRST = 0
#: A lane of this kind adds up.
SUM = 1


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64."""
    out, square, left = np.ones(len(exponents), np.uint64), base & FULL, exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] *= np.uint64(square)
        square = square * square & FULL
        left >>= np.uint64(1)
    return out


def _along(values: np.ndarray, starts: np.ndarray, run: np.ndarray, kind: int) -> np.ndarray:
    """The lane over each run of one batch, as if nothing came before."""
    if kind == FIRST:
        return values[starts][run]
    if kind == SUM:
        total = np.cumsum(values)
        return total - (total[starts] - values[starts])[run]
    n = len(values)
    scaled = np.cumsum(values * powers(n, pow(kind, -1, 1 << 64), f"down{kind}"))
    before = scaled[starts] - values[starts] * powers(n, pow(kind, -1, 1 << 64), f"down{kind}")[starts]
    return (scaled - before[run]) * powers(n, kind, f"up{kind}")


def _after(state: int, rows: np.ndarray, values: np.ndarray, kind: int) -> np.ndarray:
    """Values of `rows`-th rows behind a state."""
    if kind == FIRST:
        return np.full(len(values), state, np.uint64)
    return values + np.uint64(state) * (_power(kind, rows) if kind != SUM else np.uint64(1))


def _fold(batches: Iterator[pa.RecordBatch], key: str, lanes: dict[str, tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    state: tuple | None = None  # key, rows, lane values
    opening, held = True, None

    def sealed(batch: pa.RecordBatch, closes: bool, edge: bool) -> pa.RecordBatch:
        ends = np.zeros(batch.num_rows, bool)
        ends[:-1] = batch_changes
        ends[-1] = closes
        last = np.zeros(batch.num_rows, bool)
        last[-1] = edge
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends), pa.array(last)], names=[*batch.schema.names, "_closes", "_edge"])

    batch_changes = np.zeros(0, bool)
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        keys = column_of(batch, key)
        changes = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        goes_on = state is not None and keys[0].as_py() == state[0]
        if held is not None:
            yield sealed(held, not goes_on, False)
        starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
        run = np.concatenate([[0], np.cumsum(changes)]).astype(np.int64)
        at = np.arange(m) - starts[run] + 1
        out = {name: _along(column_of(batch, column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), starts, run, kind) for name, (column, kind) in lanes.items()}
        first = run == 0
        if goes_on:
            for name, (_, kind) in lanes.items():
                out[name][first] = _after(state[2][name], at[first], out[name][first], kind)
            at[first] += state[1]
        elif state is not None:
            opening = False
        opens = first & opening
        opening = opening and run[-1] == 0
        state = (keys[-1].as_py(), int(at[-1]), {name: int(v[-1]) for name, v in out.items()})
        head = np.zeros(m, bool)
        head[0] = held is None
        extra = {"_part": pa.array(np.full(m, part, np.int32)), "_rows": pa.array(at.astype(np.int64)), **{name: pa.array(v.view(np.int64)) for name, v in out.items()}, "_opens": pa.array(opens), "_head": pa.array(head)}
        held = pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])
        batch_changes = changes
    if held is not None:
        yield sealed(held, True, True)


def running(rows: DataFrame, key: str, order: list[Column], lanes: dict[str, tuple[str, int]], count: str) -> DataFrame:
    """rows with their number within their key (`count`, from 1), the lanes' values up to and with them, and `last`: no row
    of the key comes after. rows should be narrow and written (they are read twice); the key is never null.

    lanes: name -> (long column, kind). FIRST: the key's first value; SUM: the sum; an odd number above 1: the polynomial
    digest with that base, modulo 2 ** 64 as all lanes. drop_cut(result) when nothing reads it any more. The driver gets
    two rows a task, never more, whatever the number of rows and the size of a key.
    """
    kind = rows.schema
    for name in ("_part", "_rows", *lanes, "_opens", "_head", "_closes", "_edge"):
        kind = T.StructType([*kind, T.StructField(name, T.IntegerType() if name == "_part" else T.BooleanType() if name in ("_opens", "_head", "_closes", "_edge") else T.LongType())])
    laid = cut(rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).mapInArrow(lambda batches: _fold(batches, key, lanes), kind))
    seams = laid.where("_head or _edge").select("_part", F.col(key).alias("_key"), "_rows", *lanes, "_opens", "_head", "_edge").collect()
    heads = {r["_part"]: r["_key"] for r in seams if r["_head"]}
    edges = {r["_part"]: r for r in seams if r["_edge"]}
    parts = sorted(heads)
    carry: dict[int, tuple[int, dict[str, int]]] = {}  # of the key that a part begins with
    goes_on: set[int] = set()
    before: tuple | None = None
    for part in parts:
        if before is not None and before[0] == heads[part]:
            carry[part] = before[1:]
        e = edges[part]
        n, values = e["_rows"], {name: e[name] & FULL for name in lanes}
        if e["_opens"] and part in carry:
            had, states = carry[part]
            values = {name: states[name] if k == FIRST else (values[name] + states[name] * pow(k, n, 1 << 64)) & FULL for name, (_, k) in lanes.items()}
            n += had
        before = (e["_key"], n, values)
    for part, then in zip(parts, parts[1:], strict=False):
        if edges[part]["_key"] == heads[then]:
            goes_on.add(part)
    keep = rows.columns
    fields = T.StructType([*rows.schema, T.StructField(count, T.LongType()), *(T.StructField(name, T.LongType()) for name in lanes), T.StructField("last", T.BooleanType())])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = column_of(batch, "_part").to_numpy()
            opens = column_of(batch, "_opens").to_numpy(zero_copy_only=False)
            n = column_of(batch, "_rows").to_numpy().copy()
            values = {name: column_of(batch, name).to_numpy().view(np.uint64).copy() for name in lanes}
            last = column_of(batch, "_closes").to_numpy(zero_copy_only=False).copy()
            edge = column_of(batch, "_edge").to_numpy(zero_copy_only=False)
            for p in np.unique(part[opens | edge]).tolist():
                if p in carry:
                    mine = opens & (part == p)
                    for name, (_, k) in lanes.items():
                        values[name][mine] = _after(carry[p][1][name], n[mine], values[name][mine], k)
                    n[mine] += carry[p][0]
                if p in goes_on:
                    last[edge & (part == p)] = False
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in keep), pa.array(n), *(pa.array(v.view(np.int64)) for v in values.values()), pa.array(last)], names=fields.names)

    out = laid.mapInArrow(carried, fields)
    out._tessera_path = laid._tessera_path
    return out
