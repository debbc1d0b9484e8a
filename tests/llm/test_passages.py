import random
import re
from collections import defaultdict

import pytest

from tessera.llm.paragraphs import duplicate_paragraphs
from tessera.llm.passages import repeated_passages

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=50):
    """(doc_id, paragraph, start, n_bytes, n_words, class_id, class_start, class_size, removed) of distinct (doc_id, text)."""
    places = defaultdict(list)
    words = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        raw = text.translate(AZ)
        words[i, text] = [(m[0], len(raw[: m.start()].encode()), len(raw[: m.end()].encode()), raw.count("\n", 0, m.start())) for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", raw)]
        w = [x[0] for x in words[i, text]]
        for k in range(len(w) - size + 1):
            places[tuple(w[k : k + size])].append((i, text, k))
    again = {p: key for key, at in places.items() if len(at) > 1 for p in at}
    run, lists = {}, defaultdict(list)
    for i, text, k in sorted(again):
        run[i, text, k] = run.get((i, text, k - 1), (i, text, k))
        lists[run[i, text, k]].append(k)
    parent = {r: r for r in lists}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for p, key in again.items():
        a, b = find(run[p]), find(first.setdefault(key, run[p]))
        parent[a] = b
    groups = defaultdict(list)
    for (i, text, k), at in lists.items():
        w = words[i, text]
        groups[find((i, text, k))].append((i, w[k][1], w[k][3], w[at[-1] + size - 1][2] - w[k][1], at[-1] - k + size))
    return sorted((i, line, start, n, m, min(g)[0], min(g)[1], len(g), (i, start) != min(g)[:2]) for g in groups.values() for i, start, line, n, m in g)


def got(df):
    return sorted((r.doc_id, r.paragraph, r.start, r.n_bytes, r.n_words, r.class_id, r.class_start, r.class_size, r.removed) for r in df.collect())


def text_of(rng, n):
    return " ".join(f"k{rng.randrange(10**6)}" for _ in range(n))


def test_passage_within_longer_lines(spark, docs_of):
    """No two of these lines are alike, so that lines alone find none of the passages."""
    rng = random.Random(3)
    passage = text_of(rng, 60)
    rows = [(i, f"{text_of(rng, 150 + i)} {passage} {text_of(rng, 200)}") for i in range(4)] + [(i, text_of(rng, 400)) for i in range(4, 8)]
    assert duplicate_paragraphs(docs_of(rows), least_words=1).count() == 0
    found = got(repeated_passages(docs_of(rows)))
    assert found == brute(rows) and [r[0] for r in found] == [0, 1, 2, 3] and {r[4] for r in found} == {60}


def test_given_table_and_edges(spark, docs_of, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng = random.Random(4)
    a, b = text_of(rng, 50), text_of(rng, 49)
    rows += [(9000, None), (9001, ""), (9002, "\n\n"), (9003, f"x\ny é {a} z"), (9004, a.upper().replace(" ", ",\n") + "!"), (None, a), (9005, f"{b} q"), (9006, f"{b} r"), (9007, f"{b} q"[1:])]
    rows += [(9008, "la " * 60), (9009, f"{text_of(rng, 9)}\n" + (a + " ") * 2), (9010, "tu " * 50), (9010, "tu " * 50)]
    found = got(repeated_passages(docs_of(rows)))
    assert found == brute(rows)
    assert {9003, 9004, 9008, 9009, 9010} <= {r[0] for r in found} and not {9005, 9006, 9007} & {r[0] for r in found}


@pytest.mark.parametrize("size", [2, 3, 7])
def test_random_words(spark, docs_of, size):
    rng = random.Random(size)
    rows = [(i, "".join(rng.choice("abc") * rng.randint(1, 2) + rng.choice(" \n") for _ in range(rng.randint(0, 4 * size)))) for i in range(40)]
    assert got(repeated_passages(docs_of(rows), words=size)) == brute(rows, size)


def test_empty(spark, docs_of):
    assert repeated_passages(docs_of([])).count() == 0


def test_hot_windows(spark, docs_of, monkeypatch):
    """Windows that very many different segments share are joined apart, with the same rows."""
    rng = random.Random(5)
    passage = text_of(rng, 60)
    rows = [(i, f"{text_of(rng, 20)} {passage} {text_of(rng, 20 + i)}") for i in range(30)] + [(100 + i, text_of(random.Random(6 + i // 2), 90)) for i in range(8)]
    monkeypatch.setattr("tessera.llm.passages.HOT_ROWS", 10)
    assert got(repeated_passages(docs_of(rows))) == brute(rows)
