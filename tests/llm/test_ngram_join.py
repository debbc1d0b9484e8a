import random
import re
from collections import defaultdict

import pytest

from tessera.llm.graph import connected_components
from tessera.llm.ngram_join import jaccard_components
from tessera.llm.queries import op8_ngram_join

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    first = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                first[x].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in first.values():
        for a in members:
            for b in members:
                if a < b and find(a) != find(b):
                    inter = len(sets[a][1] & sets[b][1])
                    if den * inter >= num * len(sets[a][1] | sets[b][1]):
                        parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i is None, i or 0), len(s), -1 if i is None else least[find(k)]) for k, (i, s) in enumerate(sets))


def got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def near_copies(seed, groups, size, words, edits):
    """Groups of texts that differ from a base in a few places; chains, rings and exact copies come about."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(3)}" if rng.random() < 0.3 else f"w{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return [(i * 3 % 10_007, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small_cell", [3, 64])
@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_near_copies_against_brute_force(spark, docs_of, small_cell, n, num):
    rows = near_copies(n, 4, 60, 120, 5) + near_copies(9, 20, 4, 40, 3)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert got(jaccard_components(docs_of(rows), n=n, num=num, small_cell=small_cell)) == brute(rows, n, num, 100)


def test_query_on_given_table_and_edges(spark, folder_of, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "one "), (9005, "one two"), (9006, "ONE\x0btwo"), (None, "one two"), (9007, rows[0][1]), (9003, "other words stand here"), (9008, "é É b c d")]
    rows += [(9100, "a b c d " * 5000), (9101, "a b c d " * 6000)]
    assert got(op8_ngram_join(spark, folder_of(rows))) == brute(rows, 3, 90, 100)


def test_empty(spark, docs_of):
    assert jaccard_components(docs_of([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (5, 5), (200, 201), (201, 200), (None, 3)]
    found = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200}
