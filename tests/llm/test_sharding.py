import random
import zlib
from collections import Counter, defaultdict

from tessera.llm.queries import op1_balanced_label_propagation
from tessera.llm.sharding import balanced_shards


def check(rows, got, shards):
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_invariants_and_edges(spark, folder_of, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(9000, None), (9001, ""), (None, "x"), (None, "x"), (7, rows[0][1]), (9002, "é" * 40)] + [(10_000 + i, "the same text again and again and again") for i in range(120)]
    got = op1_balanced_label_propagation(spark, folder_of(rows)).collect()
    check(rows, got, 24)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_copies_stay_together(spark, docs_of):
    rng = random.Random(6)
    texts = []
    for _ in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(base)] * 2 + [" ".join([*base[:-1], "changed"])]
    texts += [f"lone {rng.random()}" for _ in range(600)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = balanced_shards(docs_of(rows), shards=8).collect()
    check(rows, got, 8)
    shard = {r.doc_id: r.shard for r in got}
    copies, family = defaultdict(set), defaultdict(set)
    for i, t in rows:
        if not t.startswith("lone"):
            copies[t].add(shard[i])
            family[t.split()[0]].add(shard[i])
    assert sum(len(s) > 1 for s in copies.values()) <= 8
    assert sum(len(s) > 1 for s in family.values()) <= 0.1 * len(family)


def test_small_and_empty(spark, docs_of):
    assert balanced_shards(docs_of([])).count() == 0
    check([(1, "a"), (2, "b"), (3, None)], balanced_shards(docs_of([(1, "a"), (2, "b"), (3, None)])).collect(), 24)


def cut_edges(rows, shard):
    """Pairs of texts of one family in different shards."""
    family = defaultdict(list)
    for i, t in rows:
        if not t.startswith("lone"):
            family[t.split()[0]].append(shard[i])
    return sum(a != b for f in family.values() for k, a in enumerate(f) for b in f[:k])


def test_fewer_cut_edges_than_dealing_by_hash(spark, docs_of):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(50, 50 + rng.randint(1, 6))]
    rows = list(enumerate(rows))
    shard = {r.doc_id: r.shard for r in balanced_shards(docs_of(rows), shards=8).collect()}
    assert cut_edges(rows, shard) <= 0.25 * cut_edges(rows, {i: zlib.crc32(str(i).encode()) % 8 for i, _ in rows})
