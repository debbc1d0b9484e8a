"""Shards by balanced label propagation.

Documents with equal texts are one vertex (a group larger than an eighth of a shard is split first, by a hash of the id).
Vertices are linked through keys: bands of MinHash values of five-word shingles, and the text itself for split groups. In
each round a vertex counts, over its keys, how much weight each shard holds there, and wants to move to the shard with the
most, if that is more than its own shard holds. Moves are admitted by gain until the target's quota is full. At the end the
shards' row counts are made equal to within one: surplus rows leave, unlinked ones first, and fill the gaps.

Only sums by shard, gain and hash bucket meet in one place; their number doesn't grow with the corpus. A key's row has one
column for each shard, which suits some hundreds of shards at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, drop_cut, long_lists, text_chunks
from .ngram_join import token_sets
from .paragraphs import band_keys

BUCKETS = 512
GAINS = 16


def _keys(bands: int, rows: int, n: int):
    def keys(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for _, data, offsets in text_chunks(column):
                tokens, after = token_sets(data, offsets, n, "alnum")
                size = np.diff(after)
                some = np.flatnonzero(size)
                ends = np.concatenate([[0], np.cumsum(size[some])])
                flat = band_keys(tokens, ends, bands, rows).reshape(-1) if len(some) else np.zeros(0, np.uint64)
                out.append(long_lists(flat, np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))])))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(keys, T.ArrayType(T.LongType()))


def balanced_shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 24, rounds: int = 4, bands: int = 4, rows: int = 2, n: int = 5, slack: float = 0.02) -> DataFrame:
    """One row per row of docs: the id column, size (UTF-8 bytes + 8), text_crc32, group (MD5 of the text), shard, slot
    (gapless from 0 in each shard).

    Row counts of any two shards differ by one at most. Null texts count as empty and belong together with empty ones.
    Ids may be null or repeat: rows stay apart. Other columns aren't read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    facts = cut(base.select("id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.md5("text").alias("group"), _keys(bands, rows, n)("text").alias("keys")))
    total = facts.count()
    share = max(1, total // (shards * 8))
    #: at most total / share groups, about 8 * shards, whatever the corpus
    heavy = facts.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > share).select("group", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts").cast("long")), F.lit(0)).cast("int")
    named = facts.join(F.broadcast(heavy), "group", "left").withColumn("part", part).withColumn("split", F.col("parts").isNotNull()).drop("parts")
    vertices = named.groupBy("group", "part", "split").agg(F.count("*").alias("w"), F.first("keys").alias("keys"))
    own = F.when(F.col("split"), F.array(F.xxhash64("group"))).otherwise(F.array().cast("array<bigint>"))
    vertices = cut(vertices.withColumn("keys", F.concat("keys", own)).withColumn("v", F.concat_ws("-", "group", "part")))
    begin = F.pmod(F.coalesce(F.get("keys", F.lit(0)), F.xxhash64("group")) + F.floor(F.col("part") / 8), F.lit(shards)).cast("int")
    labels = cut(vertices.select("v", "w", begin.alias("shard")))
    edges = vertices.select("v", "w", F.explode(F.array_distinct("keys")).alias("key"))
    often = edges.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    edges = cut(edges.join(often, "key", "left_semi"))
    limit = int(total / shards * (1 + slack)) + 1
    for step in range(rounds):
        after = _round(labels, edges, shards, limit, step)
        drop_cut(labels)
        labels = after

    linked = edges.select("v").distinct().withColumn("linked", F.lit(1))
    placed = named.withColumn("v", F.concat_ws("-", "group", "part")).drop("keys").join(labels.select("v", "shard"), "v").join(linked, "v", "left")
    return _evened(cut(placed), total, shards).select(F.col("id").alias(id_column), "size", "text_crc32", "group", "shard", "slot")


def _round(labels: DataFrame, edges: DataFrame, shards: int, limit: int, step: int) -> DataFrame:
    """One round of moves; half of the vertices, by a hash, may move, so that neighbours don't swap places. A key holds one
    sum for each shard, in one row, so the joins make as many rows as there are edges."""
    now = cut(edges.join(labels.select("v", F.col("shard").alias("mine")), "v"))
    sums = now.groupBy("key").agg(*[F.sum(F.when(F.col("mine") == s, F.col("w")).otherwise(0)).alias(f"s{s}") for s in range(shards)])
    held = sums.select("key", *[f"s{s}" for s in range(shards)])
    own = lambda s: F.when(F.col("mine") == s, F.col("w")).otherwise(0)
    pull = now.join(held, "key").groupBy("v").agg(F.first("w").alias("w"), F.first("mine").alias("mine"), *[F.sum(F.col(f"s{s}") - own(s)).alias(f"p{s}") for s in range(shards)])
    choices = F.array(*[F.struct(F.col(f"p{s}").alias("pull"), F.lit(-s).alias("to")) for s in range(shards)])
    best = pull.select("v", "w", F.array_max(choices).alias("best"), F.element_at(F.array(*[f"p{s}" for s in range(shards)]), F.col("mine") + 1).alias("stay"))
    gain = F.col("best.pull") - F.coalesce("stay", F.lit(0))
    wish = best.select("v", "w", (-F.col("best.to")).alias("to"), gain.alias("gain")).where((F.col("gain") > 0) & (F.pmod(F.xxhash64("v", F.lit(step)), F.lit(2)) == 0))
    wish = cut(wish.withColumn("level", F.least(F.floor(F.log2(F.col("gain"))), F.lit(GAINS - 1)).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(64)).cast("int")))
    load = {r["shard"]: r["w"] for r in labels.groupBy("shard").agg(F.sum("w").alias("w")).collect()}  # one row a shard
    room = F.element_at(F.array(*[F.lit(max(0, limit - load.get(s, 0))) for s in range(shards)]), F.col("to") + 1)
    cells = wish.groupBy("to", "level", "bucket").agg(F.sum("w").alias("w"))  # shards * GAINS * 64 rows at most
    order = Window.partitionBy("to").orderBy(F.desc("level"), "bucket")
    fits = cells.withColumn("reached", F.sum("w").over(order)).where(F.col("reached") <= room).select("to", "level", "bucket")
    moves = wish.join(F.broadcast(fits), ["to", "level", "bucket"], "left_semi").select("v", "to")
    out = cut(labels.join(moves, "v", "left").select("v", "w", F.coalesce("to", "shard").alias("shard")))
    drop_cut(now, wish)
    return out


def _evened(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows with their final shard and slot. A row's place in its shard is the sum of the smaller buckets and its number in
    its own; linked rows come first, so surplus rows are unlinked ones where there are enough."""
    bucket = F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).cast("int") + F.when(F.col("linked").isNull(), BUCKETS).otherwise(0)
    rows = placed.withColumn("bucket", bucket).withColumn("fine", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    sizes = rows.groupBy("shard", "bucket", "fine").agg(F.count("*").alias("n"))  # shards * BUCKETS * 32 rows at most
    before = Window.partitionBy("shard").orderBy("bucket", "fine").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "bucket", "fine").orderBy("group", "id", "size"))
    ranked = rows.join(starts, ["shard", "bucket", "fine"]).withColumn("rank", F.col("start") + number - 1)
    load = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    want = [total // shards + (s < total % shards) for s in range(shards)]
    have = [load.get(s, 0) for s in range(shards)]
    surplus = np.concatenate([[0], np.cumsum([max(0, h - w) for h, w in zip(have, want, strict=True)])])
    gaps = [(s, h, w - h) for s, (h, w) in enumerate(zip(have, want, strict=True)) if w > h]
    first = np.concatenate([[0], np.cumsum([g for _, _, g in gaps])])
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    extra = F.when(F.col("rank") >= at(want), at(surplus[:-1]) + F.col("rank") - at(want))
    to, slot = F.col("shard"), F.col("rank")
    for (s, h, g), f in zip(gaps, first, strict=False):
        inside = (F.col("extra") >= int(f)) & (F.col("extra") < int(f) + g)
        to, slot = F.when(inside, F.lit(s)).otherwise(to), F.when(inside, F.col("extra") - int(f) + h).otherwise(slot)
    return ranked.withColumn("extra", extra).withColumns({"slot": slot.cast("long"), "shard": to.cast("int")})
