"""Exact links between sets that meet in cells (posting lists, bands), without all pairs of a large cell.

Cells are split by size first: two sets whose sizes can reach the threshold share a size class or have neighbouring ones, so
each set visits its own class and the next. Small cells give their pairs. In a large cell a leader, the most central member,
is compared with all others, and so are further ones, picked by a hash, where several are asked for. Let d = 1 - Jaccard, a
metric, and e = 1 - threshold. Members within e of a leader are linked to it and so to each other. What is left forms the cell
of the next round. A link between a left member x and a member y near the leader implies d(x) <= 2 e and d(y) >= d(x) - e;
these pairs are compared at the end, and only where x is still in another component than the leader. After the last round (by
default there is one) the rest gives its pairs. So no link between components is lost, whatever the cells' sizes, while a
group of near copies costs one comparison a member and leader.

Most candidates never need their tokens: each set has parity bitmaps (elements counted modulo 2 a bit), a short one that
stands in the cells and, for large sets, one of about as many bits as it has elements. The bits in which two bitmaps differ
are at most the symmetric difference, so they bound the similarity; only tokens of pairs that pass move.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, sized
from .graph import connected_components

SMALL_CELL = 16
#: 64-bit words of the short bitmap; sets of more elements than it has bits have a longer one besides.
PARITY_WORDS = 4
PARITY = T.StructType([T.StructField(f"p{k}", T.LongType()) for k in range(PARITY_WORDS)])
FOLD = T.ArrayType(T.LongType())
#: Pairs that are broadcast to the sets, 40 bytes each; more of them are shuffled.
MOST_BROADCAST = 200_000
ROUNDS = 1


@dataclass
class Index:
    """marks(v, n, p, fold, id): one row a set, with its size, bitmaps and the id of a row that holds it. fetch: a written
    table of wanted (v, id) -> a written table (v, n, tokens)."""

    marks: DataFrame
    fetch: Callable[[DataFrame], DataFrame]
    num: int
    den: int


def parities(tokens: np.ndarray, after: np.ndarray) -> pa.Array:
    """The short bitmaps: struct p0, p1, ... of 64 bits each."""
    columns = []
    bit = np.uint64(1) << (tokens & np.uint64(63))
    word = (tokens >> np.uint64(6)) % np.uint64(PARITY_WORDS)
    for k in range(PARITY_WORDS):
        total = np.bitwise_xor.accumulate(np.concatenate([np.zeros(1, np.uint64), np.where(word == k, bit, np.uint64(0))]))
        columns.append(pa.array((total[after[1:]] ^ total[after[:-1]]).view(np.int64)))
    return pa.StructArray.from_arrays(columns, names=[f"p{k}" for k in range(PARITY_WORDS)])


def folds(tokens: np.ndarray, after: np.ndarray) -> pa.Array:
    """The long bitmaps: a power of two of words, with one to two bits for each element; empty for sets that the short bitmap
    serves. Halves laid over each other give the bitmap of half the words."""
    size = np.diff(after)
    words = np.where(size > 64 * PARITY_WORDS, 2 ** np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64), 0)
    starts = np.concatenate([[0], np.cumsum(words)])
    rows = np.repeat(np.arange(len(size)), size)
    long_ones = words[rows] > 0
    t, r = tokens[long_ones], rows[long_ones]
    out = np.zeros(int(starts[-1]), np.uint64)
    np.bitwise_xor.at(out, starts[r] + ((t >> np.uint64(6)).astype(np.int64) & (words[r] - 1)), np.uint64(1) << (t & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out.view(np.int64)))


def sizes_can_reach(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _short_bits(pa: Column, pb: Column) -> Column:
    return sum((F.bit_count(pa[f"p{k}"].bitwiseXOR(pb[f"p{k}"])) for k in range(PARITY_WORDS)), F.lit(0))


def bits_can_reach(na: Column, nb: Column, bits: Column, num: int, den: int) -> Column:
    """False only for pairs below num / den: by sizes, and by bits, which is at most the symmetric difference."""
    return sizes_can_reach(na, nb, num, den) & (bits * (den + num) <= (na + nb) * (den - num))


def may_link(na: Column, nb: Column, pa: Column, pb: Column, num: int, den: int) -> Column:
    return bits_can_reach(na, nb, _short_bits(pa, pb), num, den)


def bounded(pairs: DataFrame, index: Index) -> DataFrame:
    """Distinct pairs(a, b, ...) with na, nb and bits, a lower bound of their symmetric difference."""
    one = index.marks.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("fold").alias("fa"))
    two = index.marks.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("fold").alias("fb"))
    halved = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (s, t) -> s ^ t), {0})"
    long_bits = f"aggregate(zip_with({halved.format('fa', 'fb')}, {halved.format('fb', 'fa')}, (s, t) -> bit_count(s ^ t)), 0, (s, x) -> s + x)"
    both = "size(fa) > 0 and size(fb) > 0 and greatest(size(fa), size(fb)) <= 2 * least(size(fa), size(fb))"
    bits = F.when(F.expr(both), F.expr(long_bits)).otherwise(_short_bits(F.col("pa"), F.col("pb")))
    return pairs.join(one, "a").join(two, "b").withColumn("bits", bits.cast("long")).drop("pa", "pb", "fa", "fb")


def verified(pairs: DataFrame, index: Index) -> DataFrame:
    """The pairs that link, written, with `shared` and `union`, the sizes of the intersection and the union. pairs(a, b):
    distinct and written. Only tokens of sets that stand in a pair are read and moved."""
    pairs = pairs.select("a", "b")
    seen = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    wanted = cut(index.marks.join(seen, "v", "left_semi").select("v", "id"))
    sets = index.fetch(wanted)
    few = sized(pairs, MOST_BROADCAST)
    left = sets.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")).join(few, "a")
    right = sets.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")).join(few, "b")
    joined = left.join(right, ["a", "b"]).withColumn("shared", F.size(F.array_intersect("ta", "tb")).cast("long"))
    judged = joined.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("union"))
    out = cut(judged.where(F.col("shared") * index.den >= F.col("union") * index.num))
    drop_cut(wanted, sets)
    return out


def _class(n: str, num: int, den: int) -> Column:
    """Size classes: sets whose sizes can reach num / den differ by one at most."""
    return F.floor(F.log(F.col(n).cast("double")) / (max(math.log(den / num), 1e-6) * (1 + 1e-9)))


def by_size(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Each cell split by size class."""
    k = _class("n", num, den)
    visits = cells.withColumn("k", F.explode(F.array(k, k + 1)))
    return visits.withColumn("cell", F.xxhash64("cell", "k")).drop("k")


def split_cells(cells: DataFrame, small: int = SMALL_CELL) -> tuple[DataFrame, DataFrame]:
    """Cells of two members or more, as (small ones, large ones); of cells with the same members one."""
    marks = cells.groupBy("cell").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("v")).alias("x1"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("x2"))
    sizes = marks.where("members > 1").groupBy("members", "x1", "x2").agg(F.min("cell").alias("cell")).select("cell", "members")
    known = cells.join(sizes, "cell")
    return known.where(F.col("members") <= small).drop("members"), known.where(F.col("members") > small).drop("members")


def link_cells(cells: DataFrame, index: Index, small: int = SMALL_CELL, rounds: int = ROUNDS, leaders_a_cell: int = 1) -> tuple[list[DataFrame], DataFrame | None, DataFrame]:
    """(links, names, pairs): verified links (a, b), their components (vertex, component), None without any, and candidate
    pairs (a, b), each once, with which the links join all members of a cell that links within the cell join.
    cells(cell, v, n, p, central): distinct (cell, v), p with their short bitmaps."""
    num, den = index.num, index.den
    wide = max(2 * num - den, 0)
    split = cut(by_size(cells, num, den))
    few, many = split_cells(split, small)
    few, many = cut(few), cut(many)
    drop_cut(split)
    links: list[DataFrame] = []
    rings: list[tuple[DataFrame, DataFrame]] = []
    for _ in range(rounds):
        if many.isEmpty():
            break
        # the most central member, then others by a hash: groups in a cell get leaders as they have members
        picks = [F.max(F.struct("central", "v", "n", "p"))["v"], *(F.max_by("v", F.xxhash64("v", F.lit(k))) for k in range(1, leaders_a_cell))]
        chosen = many.groupBy("cell").agg(F.array_distinct(F.array(*picks)).alias("b")).select("cell", F.explode("b").alias("b"))
        leaders = chosen.join(many.select("cell", F.col("v").alias("b"), F.col("n").alias("lead_n"), F.col("p").alias("lead_p")), ["cell", "b"])
        met = many.join(leaders, "cell").where("v <> b").withColumnRenamed("v", "a")
        asked = met.where(may_link(F.col("n"), F.col("lead_n"), F.col("p"), F.col("lead_p"), wide, den)).groupBy("a", "b").agg(F.first("n").alias("n"), F.first("p").alias("p"))
        asked = cut(bounded(asked, index).where(bits_can_reach(F.col("na"), F.col("nb"), F.col("bits"), wide, den)))
        near = verified(asked.where(bits_can_reach(F.col("na"), F.col("nb"), F.col("bits"), num, den)), index)
        led = leaders.select("cell", "b")
        gone = led.join(near.select("a", "b"), "b").select("cell", F.col("a").alias("v")).unionByName(led.withColumnRenamed("b", "v"))
        after = cut(many.join(gone, ["cell", "v"], "left_anti"))
        drop_cut(many)
        many = after
        links.append(near.select("a", "b"))
        rings.append((asked, near))
    names = _names(links)
    rest = pairs_across(_distinct_cells(named(few.select("cell", "v", "n", "p").unionByName(many.select("cell", "v", "n", "p")), names)), num, den)
    for asked, near in rings:
        rest = rest.unionByName(_ring_pairs(asked, near, names, num, den))
    pairs = bounded(rest.distinct(), index).where(bits_can_reach(F.col("na"), F.col("nb"), F.col("bits"), num, den))
    pairs = cut(pairs.select("a", "b"))
    drop_cut(few, many, *[asked for asked, _ in rings])
    return links, names, pairs


def _ring_pairs(asked: DataFrame, near: DataFrame, names: DataFrame | None, num: int, den: int) -> DataFrame:
    """What is near a leader against what is farther, by leader and size class: a pair that many cells share comes up once.
    The distance of what is farther is known by its bitmap only, as a lower bound."""
    apart = asked.join(near.select("a", "b"), ["a", "b"], "left_anti").withColumn("dx", 2 * F.col("bits") / (F.col("na") + F.col("nb") + F.col("bits")))
    apart = named(named(apart, names, "a", "ca"), names, "b", "cb").where("ca <> cb")
    k = _class("n", num, den)
    apart = apart.select(F.col("a").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), "b", "dx", F.explode(F.array(k - 1, k, k + 1)).alias("k"))
    close = near.join(asked.select("a", "b", "n", "p"), ["a", "b"]).select("a", F.col("n").alias("na"), F.col("p").alias("pa"), "b", (1 - F.col("shared") / F.col("union")).alias("da"), k.alias("k"))
    reach = (F.col("da") >= F.col("dx") - (1 - num / den) - 1e-9) & may_link(F.col("nx"), F.col("na"), F.col("px"), F.col("pa"), num, den)
    return apart.join(close, ["b", "k"]).where(reach & (F.col("a") != F.col("x"))).select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b"))


def _distinct_cells(cells: DataFrame) -> DataFrame:
    """Of cells with the same members one, and none whose members are in one component already."""
    marks = cells.groupBy("cell").agg(F.count("*").alias("n1"), F.bit_xor(F.xxhash64("v")).alias("n2"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("n3"), F.min("cv").alias("low"), F.max("cv").alias("high"))
    one = marks.where("low <> high").groupBy("n1", "n2", "n3").agg(F.min("cell").alias("cell"))
    return cells.join(one.select("cell"), "cell", "left_semi")


def pairs_across(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members of the same cell in different components (cv) that may_link; a pair may come up in several cells."""
    one = cells.select("cell", F.col("v").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("cv").alias("ca"))
    two = cells.select("cell", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("cv").alias("cb"))
    bound = may_link(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), num, den)
    return one.join(two, "cell").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & bound).select("a", "b")


def _names(links: list[DataFrame]) -> DataFrame | None:
    """(vertex, component) of the links, written; None without any."""
    if not links:
        return None
    joined = connected_components(_all(links))
    out = cut(joined)
    drop_cut(joined)
    return out


def named(frame: DataFrame, names: DataFrame | None, v: str = "v", name: str = "cv") -> DataFrame:
    """frame with the component of v, v itself if it has none."""
    if names is None:
        return frame.withColumn(name, F.col(v))
    return frame.join(names.select(F.col("vertex").alias(v), F.col("component").alias(name)), v, "left").withColumn(name, F.coalesce(name, v))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def components_of(frames: list[DataFrame]) -> DataFrame:
    """(vertex, component) of the links in all frames, of which there is one at least."""
    return connected_components(_all(frames))
