"""The trie of conversation prefixes, screened by a count-min sketch.

A turn is a 128-bit digest of role and text; a prefix is the running polynomial digest of its turns (`ordered.running`), so
texts never move. Two rows of counters count the prefixes by digest. Where one of a prefix's two counters stands at one, no
other conversation has it: its node is emitted where it lies. Only possibly shared prefixes are grouped by their exact
digest. What a subtree sums up needs no walk by levels either: each node belongs to its smallest member, whose own nodes are
the end of its path, so a conversation hands one sum to each shared prefix above them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut, drop_cut
from .ordered import FIRST, SUM, running

OTHER_BASE = 0xC2B2AE3D27D4EB4F
#: Prefixes of one sketch, and counters for each of them in each of its two rows (powers of two). More prefixes are dealt out
#: to several sketches by their first turn; a sketch has 2 * 2 ** 22 * 8 bits at most, 8 MB.
SKETCH_PREFIXES, COUNTERS = 1 << 22, 8
#: Ids of conversations that end in one node are joined to texts of one such range of ids each.
ID_BLOCK = 4096
KEY = ["depth", "a", "b"]
NONE = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, y, size): two 64-bit digests of role and text (null: empty) and the text's code points. Rows
    without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return slim.select("conv_id", "turn", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"), F.length("text").cast("long").alias("size"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(turns of the rebuilt conversations with their place `p`, all conv_ids, tables to drop): conversation c takes the first
    h = crc32(c) % most turns of c - c % group, then its own after its first h. Turns are ordered by turn, null first; where
    several have the same, by the digest of role and text."""
    slim = cut(turns)
    placed = running(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("x"), F.col("y")], {}, "p")
    drop_cut(slim)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    donor = F.col("conv_id") - F.col("conv_id") % group
    ids = placed.where("p = 1").select("conv_id")
    heads = placed.where((donor == F.col("conv_id")) & (F.col("p") < most)).select(F.col("conv_id").alias("donor"), "p", "x", "y", "size")
    own = placed.where((donor == F.col("conv_id")) | (F.col("p") > h)).select("conv_id", "p", "x", "y", "size")
    borrowed = ids.where(donor != F.col("conv_id")).select("conv_id", donor.alias("donor"), h.alias("h")).join(heads, "donor").where("p <= h")
    out = cut(own.unionByName(borrowed.select("conv_id", "p", "x", "y", "size")))
    every = cut(ids)
    drop_cut(placed)
    return out, every, [out, every]


def _cells(a: str, b: str, depth: str, width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(a, b, depth), F.lit(width)), F.pmod(F.xxhash64(F.lit(7), b, a, depth), F.lit(width)) + width]


def screened(prefixes: DataFrame) -> DataFrame:
    """prefixes(conv_id, depth, a, b, pa, pb, sketch, ...) of one sketch with two more columns: `shared`, whether the
    sketch counts more than one for the prefix, and `above`, the same for the prefix without its last turn (true for the
    root). Counters are summed by executors; those above one reach the driver as one bit each."""
    spark = prefixes.sparkSession
    n = prefixes.count()
    width = 1 << max(10, (COUNTERS * min(n, SKETCH_PREFIXES) - 1).bit_length())
    counted = prefixes.select(F.explode(F.array(*_cells("a", "b", "depth", width))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    words = counted.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(2 * width // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap.view(np.uint8))

    @F.pandas_udf("boolean")
    def above_one(one: pd.Series, other: pd.Series) -> pd.Series:
        bits = sent.value
        first, second = one.to_numpy(), other.to_numpy()
        return pd.Series(((bits[first >> 3] >> (first & 7)) & (bits[second >> 3] >> (second & 7)) & 1).astype(bool))

    up = prefixes.withColumn("_d", F.col("depth") - 1)
    return up.withColumns({"shared": above_one(*_cells("a", "b", "depth", width)), "above": above_one(*_cells("pa", "pb", "_d", width)) | (F.col("depth") == 1)}).drop("_d")


def _hashed(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the ids of each node, block after block; rows arrive in order, one node's state is held."""
    node, state = None, None

    def row(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)), pa.array([d[1] for d in done], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in blocks:
        done = []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "ids")]
        for *key, ids in zip(*columns, strict=True):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield row(done)
    if node is not None:
        yield row([(node, state.hexdigest())])


def ended(ends: DataFrame) -> DataFrame:
    """ends(depth, a, b, conv_id) -> (depth, a, b, ends_sha256). Ids are joined by ranges of ids first, so that a node in which
    very many conversations end is a stream of blocks for the one task that a sha256 takes, never a list in memory."""
    blocks = ends.groupBy(*KEY, F.expr(f"floor(conv_id / {ID_BLOCK})").alias("block")).agg(F.expr("array_join(transform(array_sort(collect_list(conv_id)), c -> string(c)), ',')").alias("ids"))
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, sketch_prefixes: int = SKETCH_PREFIXES) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; all whole numbers are longs.

    turns(conv_id, p, x, y, size): digests and length of each turn, p its place; conversations(conv_id): all of them once,
    also those without turns. Both are read several times and should be written tables. The root has depth 0; without
    conversations there are no nodes. Conversations of any length and any number of copies are fine: neither the turns of one
    nor the members of a node meet in one task, but for the ids that end in one node, which stream through its sha256.
    """
    path = running(turns, "conv_id", [F.col("p")], {"a": ("x", BASE), "b": ("y", OTHER_BASE), "f": ("x", FIRST)}, "depth")
    # the digest without the last turn: (a - x) / BASE modulo 2 ** 64
    prefixes = path.mapInPandas(_with_parent, "conv_id long, depth long, a long, b long, pa long, pb long, f long, size long, last boolean")
    sketches = max(1, -(-path.count() // sketch_prefixes))
    prefixes = cut(prefixes.withColumn("sketch", F.pmod(F.xxhash64("f"), F.lit(sketches)).cast("int")), "sketch" if sketches > 1 else None)
    drop_cut(path)
    told = []
    for k in range(sketches):
        told.append(cut(screened(prefixes.where(F.col("sketch") == k) if sketches > 1 else prefixes)))
    flagged = told[0]
    for more in told[1:]:
        flagged = flagged.unionByName(more)
    drop_cut(prefixes)

    maybe, alone = flagged.where("shared"), flagged.where("not shared")
    tops = alone.where("above")  # one a conversation, and seldom more
    nodes = cut(maybe.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min("pa").alias("pa"), F.min("pb").alias("pb")))
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.select(*up).unionByName(tops.select(*up)).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    grown = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    owned = cut(
        grown.select("conv_id", *KEY, "pa", "pb", "n", "n_children", ((F.col("n") - 1) * F.col("size")).alias("w"), (F.col("n_children") == 0).cast("long").alias("ends_here"), F.lit(True).alias("grouped")).unionByName(
            tops.select("conv_id", *KEY, "pa", "pb", F.lit(1).cast("long").alias("n"), none.alias("n_children"), zero.alias("w"), F.lit(1).cast("long").alias("ends_here"), F.lit(False).alias("grouped"))
        )
    )
    below = running(owned, "conv_id", [F.col("depth").desc(), F.col("a"), F.col("b")], {"saved": ("w", SUM), "leaf": ("ends_here", SUM)}, "place")
    leaf = F.least(F.col("leaf"), F.lit(1)).cast("long")  # a conversation owns one leaf at most: its last node
    given = below.where("last").select("conv_id", F.col("depth").alias("from_depth"), F.col("saved").alias("w_saved"), leaf.alias("w_leaf"))
    reach = maybe.select("conv_id", *KEY).join(given.where("w_saved > 0 or w_leaf > 0"), "conv_id").where("depth < from_depth")
    handed = reach.groupBy(*KEY).agg(F.sum("w_saved").alias("more_saved"), F.sum("w_leaf").alias("more_leaves"))
    turnless = conversations.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")
    ends = cut(ended(maybe.where("last").select(*KEY, "conv_id").unionByName(turnless)))

    # parents: a grouped node's smallest member, the root's, or the conversation itself
    parents = nodes.select(F.col("depth").alias("_d"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("conv_id").alias("_parent"))
    on = (F.col("depth") - 1 == F.col("_d")) & (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b"))
    first = conversations.agg(F.min("conv_id").alias("_first"), F.count("*").alias("_n"))
    parent = F.when(F.col("depth") == 1, F.col("_first")).otherwise(F.coalesce("_parent", "conv_id")).alias("parent_conv_id")
    summed = below.where("grouped").join(handed, KEY, "left").join(ends, KEY, "left").join(parents, on, "left").crossJoin(F.broadcast(first))
    shared = summed.select(
        "conv_id", "depth", parent, F.col("n").alias("n_convs"), "n_children", (leaf + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    )
    one = F.lit(1).cast("long")
    tail = [one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NONE).alias("ends_sha256")]
    deep = alone.where("not above").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *tail)
    high = tops.join(parents, on, "left").crossJoin(F.broadcast(first)).select("conv_id", "depth", parent, *tail)
    sums = given.agg(F.sum("w_saved").alias("saved"), F.sum("w_leaf").alias("leaves"))
    tops_of_all = owned.where("depth = 1").agg(F.count("*").alias("children"))
    root = first.crossJoin(sums).crossJoin(tops_of_all).crossJoin(ends.where("depth = 0").agg(F.first("ends_sha256").alias("ends_sha256"))).where("_n > 0")
    root = root.select(F.col("_first").alias("conv_id"), zero.alias("depth"), none.alias("parent_conv_id"), F.col("_n").alias("n_convs"), F.col("children").alias("n_children"), F.greatest(F.coalesce("leaves", zero), one).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
    out = cut(shared.unionByName(deep).unionByName(high).unionByName(root))
    drop_cut(nodes, owned, below, ends, *told)
    return out


_INVERSE, _OTHER_INVERSE = (np.uint64(pow(b, -1, 1 << 64)) for b in (BASE, OTHER_BASE))


def _with_parent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        a, b, x, y = (f[c].to_numpy().view(np.uint64) for c in ("a", "b", "x", "y"))
        yield f.assign(pa=((a - x) * _INVERSE).view(np.int64), pb=((b - y) * _OTHER_INVERSE).view(np.int64))[["conv_id", "depth", "a", "b", "pa", "pb", "f", "size", "last"]]
