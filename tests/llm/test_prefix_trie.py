import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut
from tessera.llm.ordered import FIRST, SUM, running
from tessera.llm.prefix_trie import prefix_trie, rebuilt, turn_digests
from tessera.llm.queries import op11_prefix_trie

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    """The nodes, from lists of turns and nested prefixes."""
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in talks.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + t[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    out = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        kids = [x for x in under if len(x) == len(k) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ids = ",".join(str(c) for c in m if len(made[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks():
    rows = [(c, t, "user" if t % 2 else "assistant", f"é{t}" if t < 3 else f"{c}-{t}") for c in range(300, 330) for t in range(1, 2 + c % 7)]
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5040) for t in range(9)]  # one conversation, many times
    rows += [(7000 + c, t, "user", f"long {t}") for c in (0, 1) for t in range(150)] + [(7000, 150, None, "more")]  # two that share a long path
    rows += [(901, 1, "user", "x"), (902, None, None, None), (902, 1, "user", "second"), (1, 5, "user", "😀 wide"), (None, 1, "user", "no id"), (-250, 1, "a", "b"), (-201, 1, "a", "b")]
    return rows


@pytest.mark.parametrize("sketch_prefixes", [1 << 22, 150])
def test_matches_brute_force(spark, sketch_prefixes):
    rows = talks()
    turns, every, _ = rebuilt(turn_digests(spark.createDataFrame(rows, TURNS).repartition(5)))
    got = prefix_trie(turns, every, sketch_prefixes=sketch_prefixes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_rows_that_repeat(spark, folder_of):
    rows = [(5, 1, "user", "same"), (5, 1, "user", "same"), (6, 1, "user", "same")]
    got = {(r.depth, r.conv_id): r for r in op11_prefix_trie(spark, folder_of(conversations=spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("x"), "a": F.lit(1), "_part": F.lit(2)}))).collect()}
    assert got[0, 5].n_convs == 2 and all(r.parent_conv_id is None for (d, _), r in got.items() if d == 0)


def test_empty_table(spark, folder_of):
    assert op11_prefix_trie(spark, folder_of(conversations=spark.createDataFrame([], TURNS))).count() == 0


def test_a_key_over_many_tasks(spark):
    """One key holds nearly all rows; sums, first values and digests go on from task to task."""
    rows = [("a", i, i % 17) for i in range(3)] + [("b", i, i * i % 1009) for i in range(4000)] + [("c", i, 1) for i in range(5)]
    base = 0x10001
    slim = cut(spark.createDataFrame(rows, "k string, i long, v long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(slim, "k", [F.col("i")], {"total": ("v", SUM), "first": ("v", FIRST), "poly": ("v", base)}, "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {(r.k, r.i): r for r in got}
    assert len(by) == len(rows)
    for key in "abc":
        total = poly = 0
        mine = [r for r in rows if r[0] == key]
        for n, (_, i, v) in enumerate(mine, 1):
            total, poly = total + v, (poly * base + v) % 2**64
            r = by[key, i]
            assert (r.n, r.total, r.first, r.poly % 2**64, r.last) == (n, total, mine[0][2], poly, n == len(mine))
