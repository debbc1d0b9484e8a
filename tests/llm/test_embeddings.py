import random

import numpy as np
import pytest

from tessera.llm.embeddings import near_duplicate_vectors
from tessera.llm.queries import op7_embedding_pigeonhole


def brute(rows, cosine=0.98):
    ok = []
    for i, v, y in rows:
        good = i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, np.float32).astype(float) if good else None)
    n, links, group = len(rows), [0] * len(rows), list(range(len(rows)))
    for a in range(n):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    group = [group[a] if g == group[b] else g for g in group] if group[a] != group[b] else group
    least = {g: min(rows[k][0] for k in range(n) if group[k] == g) for g in set(group) if rows[g][0] is not None}
    return sorted((r[0] is None, r[0] or 0, links[k], -1 if r[0] is None else least[group[k]], r[0] is not None and least[group[k]] == r[0]) for k, r in enumerate(rows))


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize(("dim", "most"), [(64, 4000), (13, 7), (3, 4000)])
def test_against_brute_force(spark, dim, most):
    rng = np.random.default_rng(dim)
    rows, centre = [], rng.normal(size=dim)
    for i in range(260):
        if i % 3 == 0:
            centre = rng.normal(size=dim)
        v = (centre + rng.normal(size=dim) * random.Random(i).choice([0, 0.01, 0.1, 0.15, 1])) * (1 + i % 5)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(900, None, 1), (901, rows[0][1], None), (902, [0.0] * dim, 1), (903, [float("nan")] * dim, 1), (904, [None] + [1.0] * (dim - 1), 1), (905, [], 0), (906, [float("inf")] * dim, 1), (None, rows[0][1], 0), (907, rows[0][1], 0), (908, rows[0][1], 0), (909, [1.0, 2.0], 0), (910, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(near_duplicate_vectors(df, most_in_task=most)) == brute(rows)


def test_query_on_given_table(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert got(op7_embedding_pigeonhole(spark, small)) == brute(rows)


def test_empty(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
