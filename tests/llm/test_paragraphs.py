import random
import re
from collections import defaultdict

from tessera.llm.paragraphs import duplicate_paragraphs, tuned_bands
from tessera.llm.queries import op2_paragraph_minhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=15, n=5, num=80, den=100):
    paras = []
    for i, text in rows:
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", line.translate(AZ))
            if len(words) >= least and i is not None:
                paras.append((i, k, at, len(line.encode()), len(words), frozenset(tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1)))))
            at += len(line.encode()) + 1
    parent = list(range(len(paras)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, p in enumerate(paras):
        for s in p[5]:
            lists[s].append(k)
    for members in lists.values():
        for a in members:
            for b in members:
                if a < b and find(a) != find(b) and den * len(paras[a][5] & paras[b][5]) >= num * len(paras[a][5] | paras[b][5]):
                    parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(paras)):
        groups[find(k)].append(paras[k][:5])
    return sorted((*p, *min(g)[:2], len(g), p[:2] != min(g)[:2]) for g in groups.values() if len(g) > 1 for p in g)


def got(df):
    return sorted((r.doc_id, r.paragraph, r.start, r.n_bytes, r.n_words, r["class_id" if "class_id" in r else "class_doc_id"], r.class_paragraph, r.class_size, r.removed) for r in df.collect())


def test_given_table_and_edges(spark, folder_of, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng = random.Random(1)
    line = " ".join(f"k{rng.randrange(9999)}" for _ in range(60))
    rows += [(9000, None), (9001, ""), (9002, "\n\n"), (9003, "a\n" + line + "\nb"), (9004, line.upper() + "!\n"), (9005, "é " + line + " end"), (None, line), (9006, line + "\n" + line)]
    assert got(op2_paragraph_minhash(spark, folder_of(rows))) == brute(rows, least=1)


def test_large_bands(spark, docs_of):
    rng = random.Random(2)
    base = [f"k{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((i, f"short line\n{' '.join(w)}"))
    assert got(duplicate_paragraphs(docs_of(rows), small_cell=8)) == brute(rows)


def test_empty_and_bands(spark, docs_of):
    assert duplicate_paragraphs(docs_of([])).count() == 0
    bands, rows = tuned_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands <= 8


def test_short_lines(spark, folder_of, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(9100, "All rights reserved.\none line of six words here"), (9101, "x\nall rights reserved"), (9102, "One line of six words, here!\nX"), (9103, "...\n\n")]
    found = got(op2_paragraph_minhash(spark, folder_of(rows)))
    assert found == brute(rows, least=1)
    assert {(9101, 1), (9102, 0), (9102, 1)} <= {r[:2] for r in found}
