import math
import random
import re
from collections import Counter

import pytest

from tessera.llm.decontaminate import with_contamination
from tessera.llm.queries import op5_simhash_decontamination

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(AZ))


def grams(w, n):
    n = min(n, len(w))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if n else []


def brute(rows, items, n=5, least=0.8):
    """All windows of all lengths against all items, without fingerprints: weighted similarity where it reaches least, else plain."""
    words = [words_of(t) for _, t in rows]
    item_words = [(i, words_of(t)) for i, t in items if words_of(t)]
    sets = [set(grams(w, n)) for _, w in item_words]
    need = set().union(*sets) if sets else set()
    df = Counter()
    for w in words:
        df.update({g for k in {min(n, len(x)) for _, x in item_words} for g in (tuple(w[i : i + k]) for i in range(len(w) - k + 1))} & need)
    weight = lambda g: max(math.log((1 + len(rows)) / (1 + df[g])) / math.log(1 + len(rows)), 1e-6) if g in need else 1.0
    out = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for (item, iw), s in zip(item_words, sets, strict=True):
            if not any(g in s for g in grams(w, min(n, len(iw)))):
                continue
            best = None
            for a in range(max(1, len(w) - len(iw) + 1)):
                inside = set(grams(w[a : a + len(iw)], min(n, len(iw))))
                union = inside | s
                rare = round(sum(map(weight, inside & s)) / sum(map(weight, union)), 9)
                plain = round(len(inside & s) / len(union), 9)
                x = (rare >= least, rare if rare >= least else plain)
                if x[1] >= least and (best is None or x > best[0]):
                    best = (x, a)
            if best:
                out[doc, item] = (best[0][1], best[1])
    return out


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, folder_of, items_of):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "?!"), (53, "alpha beta gamma delta epsilon zeta eta theta")]
    items.append((54, items[5][1]))
    rows = []
    for i in range(200):
        w = rng.choices(vocabulary, k=rng.randint(0, 200))
        if i % 3 == 0:
            leak = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in leak]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "alpha beta gamma"), (903, "Alpha, beta; gamma delta epsilon zeta eta theta"), (None, items[7][1])]
    got = op5_simhash_decontamination(spark, folder_of(rows, benchmark=items_of(items))).collect()
    want = brute(rows, items)
    assert len(want) > 40
    found = {(r.doc_id, r.item_id): r for r in got}
    assert len(found) == len(got) and set(found) <= set(want)
    assert len(found) >= 0.99 * len(want) and all((d, i) in found for (d, i), (x, _) in want.items() if x >= 0.9)
    for k, r in found.items():
        assert abs(r.similarity - want[k][0]) < 1e-6 and 0 <= r.hamming <= 19


def test_blocks_of_items_and_empty_tables(spark, docs_of, items_of):
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i}") for i in range(30)]
    docs = docs_of([(i, f"x y {t} z") for i, t in items])
    whole = with_contamination(docs, items_of(items)).select("doc_id", "matches").collect()
    cut = with_contamination(docs, items_of(items), most_words=40).select("doc_id", "matches").collect()
    assert [[m.item_id for m in r.matches] for r in whole] == [[r.doc_id] for r in whole] == [[m.item_id for m in r.matches] for r in cut]
    assert with_contamination(docs_of([]), items_of(items)).count() == 0
    assert [r.matches for r in with_contamination(docs_of([(1, "a b c d e f")]), items_of([])).collect()] == [[]]


def test_near_copies_of_a_hot_item(spark, docs_of, items_of):
    """A third of the rows hold an item; copies with a plain similarity of 0.8 or more are found nevertheless."""
    rng = random.Random(9)
    item = [f"k{i}" for i in range(49)]  # 45 shingles
    one, inner, last = list(item), list(item), list(item)
    one[20], inner[2], last[48] = "changed", "changed", "changed"  # 5, 3 and 1 shingles less
    others = [" ".join(rng.choices([f"w{i}" for i in range(4000)], k=60)) for _ in range(200)]
    rows = [(i, others[i]) for i in range(200)] + [(i, f"before {' '.join(item)} after") for i in range(200, 300)]
    near = [(300 + i, " ".join(["x", "y", *w, "z"])) for i, w in enumerate((one, inner, last))]
    short = [(400, " ".join(item[:39])), (401, " ".join(item[:30]))]  # 35 and 26 of 45 shingles
    found = {r.doc_id: r.matches for r in with_contamination(docs_of(rows + near + short), items_of([(1, " ".join(item))])).collect()}
    assert all([m.item_id for m in found[i]] == [1] for i in range(200, 303))
    assert [round(found[300 + k][0].similarity, 6) for k in range(2)] == [40 / 50, 42 / 48] and found[302][0].similarity >= 0.8
    assert not any(found[i] for i in (*range(200), 400, 401))
