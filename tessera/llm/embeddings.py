"""Embedding near duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance e = 2 - 2 c. A rotation spreads that distance evenly over blocks of
few coordinates, and by the pigeonhole principle one block at least keeps to its share e * size / dimensions. So each block
has a range join of its own: a grid over its first coordinates, with cells twice as wide as the block's radius, brings each
vector to its own cell and as a guest to those it is within the radius of. A task compares the vectors of one cell, verifies
the exact cosine, and counts a pair in the first block that finds it, so the union over blocks counts each pair once.

Tasks give no pairs but sums of links for each vector and the few edges that connect a cell's components. Equal vectors are
one vertex with a multiplicity. Cells with very many vectors are split into a square of smaller tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .graph import connected_components

GRID = 2
STEP = 512


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, dim)) for a in range(0, dim, size)]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _budget(cosine: float, dim: int, a: int, b: int) -> float:
    return (2 - 2 * cosine) * (b - a) / dim + 1e-9


def _cells(batches, cosine: float, block: int):
    """For each vertex and block: its own cell, and those it visits."""
    for pdf in batches:
        out = []
        for dim, part in pdf.groupby("dim"):
            y = unit(np.stack(part["vector"].to_numpy()).astype(float)) @ rotation(dim)
            for at, (a, b) in enumerate(blocks_of(dim, block)):
                radius = np.sqrt(_budget(cosine, dim, a, b))
                width = max(2 * radius, 1e-6)
                used = min(GRID, b - a)
                home = np.floor(y[:, a : a + used] / width).astype(np.int64)
                low = np.floor((y[:, a : a + used] - radius) / width).astype(np.int64)
                high = np.floor((y[:, a : a + used] + radius) / width).astype(np.int64)
                for shift in np.ndindex(*(3,) * used):
                    cell = low + np.array(shift)
                    rows = np.flatnonzero((cell <= high).all(1))
                    if len(rows):
                        key = [f"{at}:" + ",".join(map(str, c)) for c in cell[rows]]
                        out.append(pd.DataFrame({"label": part["label"].to_numpy()[rows], "dim": dim, "cell": key, "v": part["v"].to_numpy()[rows], "home": (cell[rows] == home[rows]).all(1)}))
        yield pd.concat(out) if out else pd.DataFrame({"label": [], "dim": [], "cell": [], "v": [], "home": []})


def _linked_in_cell(pdf: pd.DataFrame, cosine: float, block: int) -> pd.DataFrame:
    """(v, links, other): sums of links, or edges where links is 0."""
    dim, at = int(pdf["dim"].iloc[0]), int(pdf["cell"].iloc[0].split(":")[0])
    spans = blocks_of(dim, block)
    x = unit(np.stack(pdf["vector"].to_numpy()).astype(float))
    y = x @ rotation(dim)
    names, many = pdf["v"].to_numpy(), pdf["many"].to_numpy()
    rank = np.argsort(np.argsort(names, kind="stable"), kind="stable")
    ask, other = np.flatnonzero(pdf["asks"].to_numpy()), np.flatnonzero(pdf["answers"].to_numpy())
    links, group, edges = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), []
    a, b = spans[at]
    for s in range(0, len(ask), STEP):
        rows = ask[s : s + STEP]
        z, w = y[rows, a:b], y[other, a:b]
        near = (z**2).sum(1)[:, None] + (w**2).sum(1) - 2 * z @ w.T <= _budget(cosine, dim, a, b) + 1e-9
        i, j = np.nonzero(near & (rank[rows][:, None] < rank[other]))
        i, j = rows[i], other[j]
        for t in range(0, len(i), 1 << 16):
            p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            good = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[good], q[good]
            mine = np.ones(len(p), bool)
            for k, (c, d) in enumerate(spans[:at]):  # an earlier block has counted it
                mine &= ((y[p, c:d] - y[q, c:d]) ** 2).sum(1) > _budget(cosine, dim, c, d)
            p, q = p[mine], q[mine]
            np.add.at(links, p, many[q])
            np.add.at(links, q, many[p])
            while True:
                apart = np.flatnonzero(group[p] != group[q])
                if not len(apart):
                    break
                one, two = p[apart[0]], q[apart[0]]
                edges.append((names[one], 0, names[two]))
                group[group == group[two]] = group[one]
    some = np.flatnonzero(links)
    return pd.concat([pd.DataFrame({"v": names[some], "links": links[some], "other": None}), pd.DataFrame(edges, columns=["v", "links", "other"])]).groupby(["v", "other"], dropna=False, as_index=False)["links"].sum()


def near_duplicate_vectors(
    embeddings: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    cosine: float = 0.98,
    block: int = 8,
    most_in_task: int = 4000,
) -> DataFrame:
    """One row per row of embeddings: the id column, n_links long, component_id, kept boolean.

    Rows link if their labels and dimensions are equal and their cosine in double precision is `cosine` or more. Rows with
    a null label, a null or empty or zero vector, or with components that are null or not finite link with nothing; so do
    rows with a null id, whose component_id is null and kept false. Rows that repeat an id all take part. component_id is
    the least id reachable. Other columns aren't read. An empty table gives no rows.
    """
    plain = embeddings.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    finite = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    able = F.col("id").isNotNull() & F.col("label").isNotNull() & F.expr(finite)
    rows = cut(plain.withColumn("v", F.when(able, F.md5(F.to_json(F.struct("label", "vector"))))))
    vertices = cut(rows.where("v is not null").groupBy("v").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("many")).withColumn("dim", F.size("vector")))
    label = rows.schema["label"].dataType.simpleString()

    def cells(batches):
        return _cells(batches, cosine, block)

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        return _linked_in_cell(pdf, cosine, block)

    visits = cut(vertices.mapInPandas(cells, f"label {label}, dim int, cell string, v string, home boolean"))
    sizes = visits.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    split = visits.join(sizes, ["label", "dim", "cell"]).withColumn("s", F.ceil(F.col("n") / most_in_task).cast("int")).withColumn("mine", F.expr("pmod(hash(v), s)"))
    square = split.withColumn("i", F.expr("explode(sequence(0, s - 1))")).withColumn("j", F.expr("explode(if(home and i = mine, sequence(0, s - 1), array(mine)))"))
    asked = square.withColumn("asks", F.col("home") & (F.col("i") == F.col("mine"))).withColumn("answers", F.col("j") == F.col("mine"))
    full = asked.join(vertices.select("v", "vector", "many"), "v").select("label", "dim", "cell", "i", "j", "v", "vector", "many", "asks", "answers")
    found = cut(full.groupBy("label", "dim", "cell", "i", "j").applyInPandas(linked, "v string, other string, links long"))
    drop_cut(visits)
    sums = found.where("other is null").groupBy("v").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("other is not null").select(F.col("v").alias("a"), F.col("other").alias("b")))

    known = rows.select("id", "v").join(vertices.select("v", "many"), "v", "left").join(sums, "v", "left")
    known = known.join(joined.select(F.col("vertex").alias("v"), "component"), "v", "left").withColumn("root", F.coalesce("component", "v"))
    least = known.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    component = F.coalesce("least", "id")
    out = known.join(least, "root", "left")
    return out.select(F.col("id").alias(id_column), (F.coalesce("links", F.lit(0)) + F.coalesce("many", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
