"""Exact k nearest neighbours by cosine: vectors in cells, queries sent to the cells that can hold an answer.

Cells have a centre and a radius (angles). A first round sends each query to its nearest cells; its k-th score there bounds
what other cells must reach: by the triangle inequality no vector of a cell is nearer than the angle to its centre less the
radius. The second round visits only cells that pass; because these can be all of them, queries aren't copied for each one but
meet the cells as packs (packs.py). Queries and vectors meet in blocks of bounded size on executors; neither side is ever
collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.packs import met, packed
from tessera.sources.shared import kept, released

#: Rows of one block of vectors or queries; with fewer vectors than that there is one cell.
BLOCK = 4096
#: Most cells. Their centres are fitted on SAMPLE vectors a cell at most and are all that the driver and each task hold.
CELLS, SAMPLE = 1024, 16
ROUNDS = 4
#: Rows that meet all vectors of a block, or all centres, at once: matrices of a worker are of SLICE x BLOCK at most.
SLICE = 128
USABLE = "vector is not null and exists(vector, x -> x <> 0) and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(x) @ centres.T, -1, 1))


def _best(cosine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest finite values of each row, then the smallest ids: what is below a row's k-th isn't sorted."""
    k = min(k, cosine.shape[1])
    kth = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
    row, column = np.nonzero((cosine >= kth[:, None]) & np.isfinite(cosine))
    order = np.lexsort((ids[column], -cosine[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)  # where a row begins
    few = np.arange(len(row)) - first < k
    return row[few], column[few]


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by a few rounds of k-means on the sphere; every k-th of the sample to begin with."""
    x = _units(sample)
    centres = x[:: max(1, len(x) // cells)][:cells]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1)
        full = length > 1e-12
        centres = centres.copy()
        centres[full] = sums[full] / length[full][:, None]
    return centres


class VectorIndex:
    """vectors(id, vector[, same]) in cells. Null, zero and non-finite vectors, and those of another length than `dim`, are in
    no cell. release() when nothing searches it any more."""

    def __init__(self, vectors: DataFrame, dim: int, same: str | None = None, block: int = BLOCK, cells: int = CELLS):
        self.same, self.block, self.spark = same, block, vectors.sparkSession
        columns = ["id", "vector", *([same] if same else [])]
        source = vectors.where(USABLE).where(F.size("vector") == dim).select(*columns)
        if same:
            source = source.where(F.col(same).isNotNull())
        n = source.count()
        self.cells = 1 if n <= block else min(cells, max(1, int(n**0.5) // 2))
        if self.cells == 1:
            self.centres = None
            self.rows, self.sizes, self.radius = source.withColumn("cell", F.lit(0)), np.array([n]), np.array([np.pi])
            return
        sample = _matrix(source.orderBy(F.xxhash64("id")).select("vector").limit(SAMPLE * self.cells).toArrow().column(0))
        self.centres = _fitted(sample, self.cells)
        self.cells = len(self.centres)
        sent = self.spark.sparkContext.broadcast(self.centres)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    angles = _angles(_matrix(batch.column(1)), sent.value)
                    cell = angles.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

        self.rows = kept(source.mapInArrow(placed, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in source.schema)}, cell int, angle double"), "cells")
        self.sizes, self.radius = np.zeros(self.cells, np.int64), np.zeros(self.cells)
        for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # a row a cell
            self.sizes[r["cell"]], self.radius[r["cell"]] = r["n"], r["angle"]

    def release(self) -> None:
        released(self.rows)

    def _chosen(self, k: int, second: bool):
        """A function that tells for (vectors, least) which cells each query visits, as a Boolean matrix. The first round's cells hold
        2 k vectors and a block's share at least; the second round's are the others whose bound reaches the query's `least`."""
        centres, radius, sizes, near = self.spark.sparkContext.broadcast(self.centres), self.radius, self.sizes, max(2 * k, self.block // 8)

        def chosen(vectors: np.ndarray, least: np.ndarray | None) -> np.ndarray:
            angles = _angles(vectors, centres.value)
            bound = np.maximum(angles - radius, 0)
            order = np.lexsort((angles, bound), axis=1)
            held = np.take_along_axis(np.broadcast_to(sizes, angles.shape), order, axis=1)
            go = np.zeros(angles.shape, bool)
            np.put_along_axis(go, order, np.cumsum(held, axis=1) - held < near, axis=1)
            if second:
                with np.errstate(invalid="ignore"):
                    go = ~go & ~(np.cos(np.minimum(bound, np.pi)) < (least - 1e-8)[:, None])  # no k-th score yet: all cells
            return go & (sizes > 0)

        return chosen

    def _visits(self, queries: DataFrame, k: int) -> DataFrame:
        """queries with one row for each cell to visit in the first round, in the column cell."""
        if self.centres is None:
            return queries.withColumn("cell", F.lit(0))
        names, chosen = queries.columns, self._chosen(k, second=False)

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
                go = chosen(_matrix(batch.column(names.index("vector"))), None)
                cells = pa.ListArray.from_arrays(pa.array(np.append(0, go.sum(axis=1).cumsum()).astype(np.int32)), pa.array(np.nonzero(go)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*names, "cells"])

        found = queries.mapInArrow(visited, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in queries.schema)}, cells array<int>")
        return found.select(*names, F.explode("cells").alias("cell"))  # a query's vector leaves Python once

    def _met(self, visits: DataFrame, k: int) -> tuple[DataFrame, int]:
        """(query_id, id, score) of the k best of each visit, and the pairs compared."""
        counted = visits.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row a cell
        plan = [(r["cell"], max(1, -(-int(self.sizes[r["cell"]]) // self.block)), max(1, -(-r["n"] // self.block))) for r in counted]
        pairs = sum(r["n"] * int(self.sizes[r["cell"]]) for r in counted)
        blocks = F.broadcast(self.spark.createDataFrame(plan, "cell int, vs int, qs int"))
        spread = lambda own, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(own)
        same = [self.same] if self.same else []
        mine = [F.col(c).alias(f"asked_{c}") for c in ("vector", *same)]  # queries may come from the vectors' own table
        left = visits.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("qb"), F.col("query_id").alias("query_id"), *mine, spread("vb", "vs"))
        right = self.rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int").alias("vb"), "id", "vector", *same, spread("qb", "qs"))

        def best(asked: pa.Table, held: pa.Table) -> pa.Table:
            q, ids = asked.column("query_id").to_numpy(), held.column("id").to_numpy()
            if not len(q) or not len(ids):
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            vectors, found = _units(_matrix(held.column("vector"))), []
            for at in range(0, len(q), SLICE):
                some = asked.slice(at, SLICE)
                cosine = np.round(_units(_matrix(some.column("asked_vector"))) @ vectors.T, 9)
                if same:
                    cosine = np.where(some.column(f"asked_{same[0]}").to_numpy()[:, None] == held.column(same[0]).to_numpy()[None], cosine, -np.inf)
                row, column = _best(cosine, ids, k)
                found.append((q[at + row], ids[column], cosine[row, column]))
            query, other, score = map(np.concatenate, zip(*found, strict=True))
            return pa.table({"query_id": query, "id": other, "score": score})

        key = ["cell", "vb", "qb"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, "query_id long, id long, score double"), pairs

    def _met_rest(self, asked: DataFrame, n: int, k: int) -> tuple[DataFrame, int]:
        """(query_id, id, score) of the k best of the second round's cells for each of n queries(query_id, vector, least[, same]), and
        the pairs compared."""
        chosen, sizes, same = self._chosen(k, second=True), self.sizes, self.same

        def least_of(rows: pa.Table) -> np.ndarray:
            return rows.column("least").to_numpy().astype(float)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (pa.Table.from_batches([whole.slice(at, SLICE)]) for whole in batches for at in range(0, whole.num_rows, SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([int((chosen(_matrix(batch.column("vector")), least_of(batch)) @ sizes).sum())])], names=["pairs"])

        asked_groups: dict[int, tuple] = {}  # of a task

        def group(rows: pa.Table) -> tuple:
            """(vectors, values of same, cells to visit) of a group of queries."""
            units, least = _units(_matrix(rows.column("vector"))), least_of(rows)
            go = np.concatenate([chosen(units[at : at + SLICE], least[at : at + SLICE]) for at in range(0, len(units), SLICE)])
            return units, rows.column(same).to_numpy().copy() if same else None, go

        def best(number: int, rows: pa.Table, held: pa.Table) -> tuple[np.ndarray, ...]:
            if number not in asked_groups:
                asked_groups[number] = group(rows)
            (units, sames, go), ids, vectors = asked_groups[number], held.column("id").to_numpy(), _units(_matrix(held.column("vector")))
            mine, found = np.flatnonzero(go[:, held.column("cell")[0].as_py()]), [(np.zeros(0, np.int64), ids[:0], np.zeros(0))]
            for at in range(0, len(mine), SLICE):
                some = mine[at : at + SLICE]
                cosine = np.round(units[some] @ vectors.T, 9)
                if same:
                    cosine = np.where(sames[some][:, None] == held.column(same).to_numpy()[None], cosine, -np.inf)
                row, column = _best(cosine, ids, k)
                found.append((some[row], ids[column], cosine[row, column]))
            return tuple(map(np.concatenate, zip(*found, strict=True)))

        pairs = asked.mapInArrow(counted, "pairs long").agg(F.sum("pairs")).first()[0] or 0
        blocks = [max(1, -(-int(size) // self.block)) for size in sizes]
        begins = F.array(*[F.lit(int(x)) for x in np.append(0, np.cumsum(blocks)[:-1])])
        block = F.get(begins, F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.array(*map(F.lit, blocks)), F.col("cell")))
        groups = max(1, -(-n // self.block))
        found = met(packed(asked, F.pmod(F.xxhash64("query_id"), F.lit(groups))), groups, packed(self.rows.drop("angle"), block), sum(blocks), best, k, "query_id long, id long, score double", "nearest")
        return found, pairs

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the k greatest cosines of each query, rounded to 9 digits, then the smallest ids.
        `compared` tells the pairs compared and all pairs."""
        asked = queries.where(USABLE)
        if self.same:
            asked = asked.where(F.col(self.same).isNotNull())
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        top = lambda df: df.withColumn("rank", place).where(F.col("rank") <= k)
        found, pairs = self._met(self._visits(asked, k), k)
        if self.centres is None:
            self.compared = (pairs, pairs)
            return top(found)
        first = kept(top(found), "nearest")
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        n = asked.count()
        rest = kept(asked.join(least, "query_id", "left"), "asked")
        more, others = self._met_rest(rest, n, k)
        out = kept(top(first.select("query_id", "id", "score").unionByName(more)), "nearest")
        released(first, rest, more)
        self.compared = (pairs + others, n * int(self.sizes.sum()))
        return out


def knn(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k vectors with the greatest cosine. queries(query_id, vector[, same]), vectors(id,
    vector[, same]); with `same` only vectors with the query's value count. query_id is unique; all queries must have one
    length, vectors of another length match nothing, nor do null, zero and non-finite ones."""
    dims = queries.where(USABLE).agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if dims["least"] != dims["most"]:
        raise ValueError("query vectors differ in length")
    index = VectorIndex(vectors, dims["most"] or 0, same, block)
    found = index.search(queries, k)
    index.release()
    return found
