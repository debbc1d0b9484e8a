import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.queries import op3_toxicity
from tessera.llm.queries import trains
from tessera.llm.toxicity import DISCOUNTS, PAIR_FACTOR, counted, fit_logistic, score_toxicity

WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "la le li lo lu ma me mi mo mu".split()]
BAD = ["vile", "rotten", "filthy"]


def corpus(n=1200):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 120))
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD).upper())
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture
def label_frame(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(spark, folder_of, label_frame):
    docs, labels = corpus()
    extra = [(5_000, None), (5_001, ""), (5_002, "!?"), (None, "filthy vile"), (3, docs[3][1])]
    got = op3_toxicity(spark, folder_of(docs + extra, labels=label_frame([*labels, (None, 1, 1), (7, 0, None)]))).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert len(held) > 300 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (5_000, 5_001, 5_002))


def test_held_out_labels_are_never_read(spark, folder_of, label_frame, tmp_path):
    docs, labels = corpus(400)
    one = {r.doc_id: r.score for r in op3_toxicity(spark, folder_of(docs, labels=label_frame(labels))).collect()}
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert one == {r.doc_id: r.score for r in op3_toxicity(spark, folder_of(docs, labels=label_frame(turned))).collect()}


def test_without_labels(spark, folder_of, label_frame):
    got = op3_toxicity(spark, folder_of([(1, "a b")], labels=label_frame([]))).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)]
    assert op3_toxicity(spark, folder_of([], labels=label_frame([]))).count() == 0


def test_logistic():
    weights, loss = fit_logistic(np.array([[0.0, 1], [1, 1], [2, 1], [3, 1]] * 50), np.array([0.0, 0, 1, 1] * 50))
    at = lambda x: weights @ [x, 1, 1]
    assert at(1) < 0 < at(2) and loss < 0.5


def plain_ratios(corpus, taught, text, d):
    """Mean ratios of a text under both models, with dictionaries."""
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    pairs = lambda t: list(zip(["", *words(t)], words(t)))
    n = [Counter(), Counter()]
    two = [Counter(), Counter()]
    for t, y in set(taught):
        n[y].update(set(words(t)))
        two[y].update(set(pairs(t)))
    shared = Counter(w for t in set(corpus) for w in set(words(t)))
    total = sum(shared.values()) + len(shared) + 1
    q = lambda w: (shared[w] + 1) / total
    own = DISCOUNTS[d]

    def word(c, w):
        return max(n[c][w] - own, 0) / sum(n[c].values()) + sum(min(x, own) for x in n[c].values()) / sum(n[c].values()) * q(w)

    def pair(c, h, w):
        after = {k: x for k, x in two[c].items() if k[0] == h}
        if not after:
            return word(c, w)
        each = PAIR_FACTOR * own
        return (max(two[c][h, w] - each, 0) + sum(min(x, each) for x in after.values()) * word(c, w)) / sum(after.values())

    vocabulary = set(shared)
    for c in (0, 1):  # distributions: with the one unseen word of q they sum to 1
        assert abs(sum(word(c, w) for w in vocabulary) + sum(min(x, own) for x in n[c].values()) / sum(n[c].values()) / total - 1) < 1e-9
    of_word = [math.log(word(1, w) / word(0, w)) for w in words(text)]
    of_pair = [math.log(pair(1, h, w) / pair(0, h, w)) for h, w in pairs(text)]
    return np.mean(of_pair), max(of_pair), np.mean(of_word), max(of_word)


def test_model_against_dictionaries(spark):
    rng = random.Random(4)
    some = WORDS[:25]
    texts = [" ".join(rng.choices(some + (BAD if k % 3 == 0 else []), k=rng.randint(3, 30))) for k in range(90)]
    texts += texts[:12]
    taught = [(t, int(k % 3 == 0)) for k, t in enumerate(texts[:60])] + [(texts[1], 0)]
    slim = spark.createDataFrame([*enumerate(texts), (500, None)], "id long, text string")
    counts = counted(slim, spark.createDataFrame(taught, "text string, label int"), (1,))
    for text in [*texts[55:75], "none of these known", texts[0]]:
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        for d in (0, 1, 3):
            assert np.allclose(counts.features(data, offsets, d)[0], plain_ratios(texts, taught, text, d))


def test_columns_of_any_name_stay(spark, docs_of, label_frame):
    docs, labels = corpus(200)
    odd = docs_of(docs).withColumnsRenamed({"lang": "Score", "source": "evidence", "n_chars": "toxicity"}).withColumn("a`b. c", F.lit(7))
    out = score_toxicity(odd, label_frame(labels), trains())
    assert out.columns == [*odd.columns, "toxicity_"]
    first = out.where("doc_id = 3").first()
    assert (first["evidence"], first["a`b. c"], first["toxicity"], first["Score"]) == ("s", 7, None, None) and 0 <= first["toxicity_"]["score"] <= 1
