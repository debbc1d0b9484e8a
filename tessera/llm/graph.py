"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _sum_of(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any orderable type -> (vertex, component): the smallest vertex reachable, for each vertex that
    has an edge. Loops and repeated edges do no harm. Each round aggregates minima by vertex (partial sums first) and
    joins them back, so that a vertex with very many edges is never gathered in one place."""
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _sum_of(now)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        after = cut(small.where("a <> b").distinct())
        got = _sum_of(after)
        drop_cut(now)
        now, same, seen = after, got == seen, got
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
    out._tessera_path = now._tessera_path  # drop_cut(out) when nothing reads it any more
    return out
