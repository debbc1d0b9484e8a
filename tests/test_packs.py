"""What searches and corrective retrieval write to disk: every row once or a few times, not once for each group or row that it meets."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import packs, text_index
from tessera.operators import reflection as R
from tessera.operators.text_index import TextIndex
from tessera.operators.vector_index import VectorIndex


def shuffled(spark, f) -> int:
    """Bytes that f writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def so_far() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = so_far()
    f()
    return so_far() - before


def test_text_search_grows_with_its_input(spark, monkeypatch):
    for name, n in (("DOCS", 100), ("QUERIES", 50)):
        monkeypatch.setattr(text_index, name, n)
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))

    def written(times: int) -> int:
        docs = spark.createDataFrame([(i, some(100)) for i in range(400 * times)], "id long, text string")
        asked = spark.createDataFrame([(i, some(30)) for i in range(200 * times)], "query_id long, text string")
        index = TextIndex(docs)
        return shuffled(spark, lambda: index.search(asked, 5).count())

    assert written(4) < 6 * written(1)  # 4 times the rows; 16 times the pairs


def test_vector_search_grows_with_its_input(spark):
    """Random directions, which no cell can leave out."""
    rng = np.random.default_rng(4)

    def written(times: int) -> int:
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800 * times, 24)))]
        vectors = spark.createDataFrame(rows, "id long, vector array<double>")
        index = VectorIndex(vectors, 24, block=100, cells=16 * times)
        found = shuffled(spark, lambda: index.search(vectors.withColumnRenamed("id", "query_id"), 5).count())
        index.release()
        return found

    assert written(4) < 6 * written(1)


def test_corrective_moves_a_text_once(spark):
    """200 questions that all find the same five pages of random letters."""
    rng = np.random.default_rng(5)
    noise = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5000))
    pages = spark.createDataFrame([(i, f"The tides follow moon and sun. {noise()}") for i in range(5)], "id long, text string")
    asked = [(i, 1, f"the tides follow moon and sun {i}", []) for i in range(200)]
    asked = spark.createDataFrame(asked, "conv_id long, turn long, question string, chunks array<struct<rank: int, id: long, source: string, text: string>>")
    got = []
    written = shuffled(spark, lambda: got.extend(R.corrected(asked, pages, F.lit(True)).collect()))
    assert len(got) == 200 and all(r.web_used and r.n_evidence == 5 for r in got)
    assert written < 1_000_000  # a text for each of 1000 hits is 5 MB


def test_grades_of_a_text_that_very_many_ask_for(spark, monkeypatch):
    """A text's pairs are dealt to several copies; each row gets its grades in the order of the ranks, texts that lack are left out."""
    monkeypatch.setattr(R, "GRADED_FOR", 7)
    corpus = spark.createDataFrame([(1, "Alpha beta gamma."), (2, "Beta alone."), (3, "unasked")], "id long, text string")
    pairs = [(row, ["alpha", "beta"], rank, page) for row in range(50) for rank, page in ((1, 2), (2, 1), (3, 9))]
    found = R.grades_of(spark.createDataFrame(pairs, "row long, q array<string>, rank int, id long"), corpus).collect()
    want = [(2, 0.5, False, ["beta"]), (1, 1.0, True, ["alpha", "beta"])]
    assert {r.row: [(g.id, g.relevance, g.supports, sorted(g.words)) for g in r.grades] for r in found} == {row: want for row in range(50)}


def test_best_rows():
    row, ids, score = np.array([1, 0, 1, 1, 0]), np.array([5, 4, 3, 9, 2]), np.array([1.0, 2.0, 1.0, 3.0, 2.0])
    assert packs.best_rows(row, ids, score, 2).tolist() == [4, 1, 3, 2]  # ties: the smaller id first
