import random
from collections import defaultdict

import corpus_pipeline
from tests.llm import test_decontaminate, test_ngram_join, test_packing, test_suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """Ordinary and toxic texts, near copies, shared passages, benchmark items, and the odd rows."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(make(30))) for i in range(8)]
    passage = " ".join(make(60))
    rows, labels = [], []
    for i in range(360):
        words = make(rng.randint(20, 120))
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten"]))
        if i % 9 == 1:
            words[3:3] = rng.choice(items)[1].split()
        text = " ".join(words)
        if i % 7 == 2:
            text += "\n" + passage + "\n"
        rows.append((i, text))
        labels.append((i, 1, toxic))
    for i in range(20):
        words = rows[10 * i + 1][1].split(" ")
        words[-1] = "other"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (None, "alone here"), (2002, "é" * 4000), (7, rows[7][1]), (9, "an id that comes twice")]
    base = make(40)
    rows += [(3000, " ".join(base)), (3007, " ".join(make(40))), (3007, " ".join([*base, "tail"])), (3008, None), (3008, None)]
    return rows, labels, items


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=repr)


def near_groups(rows):
    """Different rows that link, directly or not, as sets of two or more."""
    rows = sorted({x for x in rows if x[0] is not None}, key=repr)
    sets = [test_ngram_join.shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[a] if g == group[b] else g for g in group]
    out = defaultdict(set)
    for g, x in zip(group, rows, strict=True):
        out[g].add(x)
    return [g for g in out.values() if len(g) > 1]


def test_stages_against_brute_force(spark, folder_of):
    rows, labels, items = corpus()
    folder = folder_of(rows, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name in list(stages)[:-1]:
        docs = stages[name](spark, docs, folder)
        assert docs.columns == COLUMNS
        kept[name] = pairs(docs)
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)

    bad = {i for i, _, t in labels if t}
    left = {i for i, _ in kept["toxicity"]}
    assert len(left & bad) <= 0.05 * len(bad) and len({i for i, _ in rows} - left - bad) <= 6

    before = kept["toxicity"]
    groups = near_groups(before)
    texts = [t for _, t in kept["near_duplicates"]]
    assert all((i, t) in before for i, t in kept["near_duplicates"])
    for group in groups:  # one row of each group, with its least id
        stay = [x for x in kept["near_duplicates"] if x in group]
        assert len(stay) == 1 and stay[0][0] == min(i for i, _ in group), group
    single = {x for x in before if not any(x in g for g in groups)}
    assert {x for x in kept["near_duplicates"] if x[0] is None or x in single} >= single
    assert len(texts) == len(groups) + sum(1 if x[0] is not None else before.count(x) for x in single)
    assert [t.endswith("tail") for i, t in kept["near_duplicates"] if i == 3007] == [False]

    spans = test_suffix_dedup.brute([x for x in kept["near_duplicates"] if x[0] is not None], 200)
    lengths = sorted((i, len((t or "").encode())) for i, t in kept["repeated_passages"] if i is not None)
    assert lengths == sorted((i, n - gone) for _, i, n, gone, _, _ in spans) and any(gone for _, _, _, gone, _, _ in spans)

    leaks = test_decontaminate.brute(kept["repeated_passages"], items)
    assert leaks and order(kept["decontamination"]) == order(x for x in kept["repeated_passages"] if x[0] not in {d for d, _ in leaks})

    final = corpus_pipeline.run(spark, folder).collect()  # all stages anew
    left = kept["decontamination"]
    alone = [x for x in left if x[0] is not None and sum(y[0] == x[0] for y in left) == 1]
    assert test_packing.check(alone, final, 2048) < len(left) / 2
    assert {p.doc_id for p in final} == {i for i, _ in kept["decontamination"]}


def test_empty_tables(spark, folder_of):
    folder = folder_of([], labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_columns_of_any_name_stay(spark, folder_of, docs_of):
    """Names that stages use inside, of other types and with odd characters, keep their values through all stages."""
    names = ["score", "evidence", "toxicity", "matches", "__text", "__kept", "__T1", "__t2", "__id", "id", "n", "a`b. c"]
    rows, labels, items = corpus()
    rows = rows[:60] + [(5000, "twice"), (5000, "twice")]
    folder = folder_of(rows, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs = docs_of(rows)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + k)
    docs.write.parquet(f"{folder}/wide.parquet")
    docs = spark.read.parquet(f"{folder}/wide.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        got = after.collect()
        assert got and all(r[name] == (None if r["doc_id"] is None else r["doc_id"] * 100 + k) for r in got for k, name in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(rows)
