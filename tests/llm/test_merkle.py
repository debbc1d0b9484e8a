import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.queries import op12_merkle_manifest

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    """All levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    for level in levels[:-1]:
        run = i - i % 8
        yield level[run:i], level[i + 1 : run + 8]
        i //= 8


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climbed([leaf(r) for r in groups[x]]) for x in langs}
    top = climbed([trees[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            proof = [*sides(trees[lang], i), *sides(top, at)]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], r[4] and r[4].translate(AZ))) if touched else leaf(r)
            for left, right in proof:
                node = sha(*left, node, *right)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha(*(x for s in proof for x in (*s[0], *s[1]))), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of():
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(700)]  # four levels, the last run short
    rows += [(i, None, "de", None, None) for i in range(2000, 2064)] + [(i, "s", "fr", 1, "") for i in range(3000, 3009)]
    rows += [(1, "s", None, 2, "UPPER"), (5, "s", "", 2, "Alone"), (None, "s", "en", 1, "No id"), (5, "s", "en", 2, "Id again"), (6, "s6", "é", 6, "x"), (7, "s", "lone", 1, "ABC")]
    return rows + [(i, "s", f"l{i}", 1, "T") for i in range(9000, 9080)] + [(8, "s", "twice", 1, "Same"), (8, "s", "twice", 1, "Same"), (9, "s", "long", 1, "LONG" * 300_000)]


def test_matches_brute_force(spark, folder_of, tmp_path):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "K": F.lit(2)})
    got = op12_merkle_manifest(spark, folder_of(documents=docs.repartition(7)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}


def test_one_row_and_none(spark, folder_of):
    one = [(3, "s", "en", 1, None)]
    assert [tuple(r) for r in op12_merkle_manifest(spark, folder_of(documents=spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string"))).collect()] == brute(one)
    assert op12_merkle_manifest(spark, folder_of()).count() == 0
