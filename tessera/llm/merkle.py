"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups' roots, and the rows' proofs.

Checkpoint and recompute: of the levels between leaves and root only every second one is written. A proof needs all of them;
for each aligned subtree of 64 stored nodes the level between is worked out again, gives its siblings and is gone. Proofs grow
from the root downwards, so that no join meets more than the 64 nodes below one stored node, whatever a group's size.
Places in a group come from `ordered.running`: a group with a third of all rows, or all of them, is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, sized
from .ordered import running

FANOUT = 8
#: Nodes of a stored level below one node of the next stored level.
SUBTREE = FANOUT * FANOUT
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """sha256 over the values: `-` for null, else UTF-8 byte count, colon, value; whole numbers in decimal."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _subtrees(nodes: DataFrame, level: int, more: list[str]) -> DataFrame:
    """(tree, j, up, nodes, d, mid) of the nodes whose trees rise above this level: up to 64 stored nodes below one of the next
    stored level in order, their digests, and the level between (empty where the next level is the root)."""
    found = nodes.where(F.col("height") > level).groupBy("tree", F.expr(f"i div {SUBTREE}").alias("j")).agg(F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("i", "digest", *more))).alias("nodes"))
    found = found.withColumn("d", F.col("nodes.digest"))
    return found.withColumn("mid", F.expr(f"if(height > {level + 1}, transform(sequence(0, cast((size(d) - 1) div {FANOUT} as int)), g -> sha2(array_join(slice(d, {FANOUT} * g + 1, {FANOUT}), ''), 256)), cast(array() as array<string>))"))


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """Written tables (tree, height, i, digest): the leaves as they are, then every second level; a tree ends with the table
    that holds its root. One job a stored level, as many as the logarithm to base 64 of the largest tree."""
    levels = [leaves]
    most = leaves.agg(F.max("height")).first()[0] or 0
    while 2 * (len(levels) - 1) < most:
        at = 2 * (len(levels) - 1)
        up = _subtrees(levels[-1], at, []).select("tree", "height", F.col("j").alias("i"), F.sha2(F.array_join(F.when(F.size("mid") > 0, F.col("mid")).otherwise(F.col("d")), ""), 256).alias("digest"))
        levels.append(cut(up))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's root."""
    found = None
    for k, nodes in enumerate(levels):
        done = nodes.where((F.col("height") <= 2 * k) & (F.col("height") > 2 * k - 2)).select("tree", "digest")
        found = done if found is None else found.unionByName(done)
    return found


def paths(levels: list[DataFrame], above: DataFrame, carried: list[str], payload: list[str]) -> DataFrame:
    """Leaves with their payload columns, `path` (siblings to the left and right, level by level up to the root and on along
    what `above` (tree, path, *carried) has for their tree), and the carried columns."""
    known = None
    for k in range(len(levels) - 1, -1, -1):
        more = payload if k == 0 else []
        ended = levels[k].where((F.col("height") <= 2 * k) & (F.col("height") > 2 * k - 2)).join(above, "tree").select("tree", "i", "digest", *more, "path", *carried)
        if known is None:
            known = ended
            continue
        up = known.select("tree", F.col("i").alias("j"), "path", *carried)
        low = f"struct(array_join(slice(d, m - m % {FANOUT} + 1, m % {FANOUT}), '') as left, array_join(slice(d, m + 2, {FANOUT - 1} - m % {FANOUT}), '') as right)"
        run = f"cast(m div {FANOUT} as int)"
        high = f"struct(array_join(slice(mid, 1, {run}), '') as left, array_join(slice(mid, {run} + 2, {FANOUT}), '') as right)"
        each = f"transform(nodes, (x, m) -> struct(x as node, concat(if(size(mid) > 0, array({low}, {high}), array({low})), path) as path))"
        inside = _subtrees(levels[k], 2 * k, more).join(up, ["tree", "j"]).select("tree", F.explode(F.expr(each)).alias("x"), *carried)
        known = inside.select("tree", "x.node.i", "x.node.digest", *(f"x.node.{c}" for c in more), "x.path", *carried).unionByName(ended)
    return known


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows(tree, ...) with their place `i` in their tree and the tree's height."""
    run = running(rows, "tree", order, {}, "place")
    sizes = run.where("last").select("tree", F.expr(f"if(place = 1, 0, length(conv(string(place - 1), 10, {FANOUT})))").alias("height"))
    # one row a tree; where there are too many to broadcast, no tree but a few can be large, and Spark splits their side
    out = cut(run.join(sized(sizes), "tree").withColumn("i", F.col("place") - 1).drop("place", "last"))
    drop_cut(run)
    return out


def manifest(docs: DataFrame, fields: list[str], group: str, key: str, tampered: Column | None = None) -> DataFrame:
    """One row for each row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of `fields`; those of a group ascend by key (null first), and of rows that repeat a key by leaf. Equal
    rows have equal leaves, each with its own place. A null group is a group of its own and the first; groups are ordered by
    UTF-8 bytes. tampered: the leaf digest of a row as somebody has changed it, null where it is as it was; proofs are those
    of the untouched rows. Very long texts are hashed where they are read; only digests move. An empty table gives no rows.
    """
    values = [F.col(f"`{f}`") for f in fields]
    leaf = leaf_digest(values)
    changed = tampered if tampered is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    slim = cut(docs.select(tree.alias("tree"), F.col(f"`{key}`").alias("k"), leaf.alias("digest"), changed.alias("changed")))
    placed = _placed(slim, [F.col("k").asc_nulls_first(), F.col("digest")])
    drop_cut(slim)
    levels = stored_levels(placed)
    # null's tree is "-", which sorts before "=..."; behind the mark the order is that of the groups
    tops = cut(roots(levels).select(F.lit("all").alias("tree"), F.col("tree").alias("group"), "digest"))
    top_placed = _placed(tops, [F.col("group")])
    drop_cut(tops)
    top_levels = stored_levels(top_placed)
    root = roots(top_levels).select("tree", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("digest").alias("root"))
    above = paths(top_levels, root, ["root"], ["group"]).select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    proved = paths(levels, above, ["subroot", "root"], ["k", "changed"])
    folded = F.expr("aggregate(path, coalesce(changed, digest), (a, s) -> sha2(concat(s.left, a, s.right), 256))")
    out = proved.select(F.col("k").alias(key), F.col("digest").alias("leaf"), "subroot", "root", F.expr("sha2(array_join(transform(path, s -> concat(s.left, s.right)), ''), 256)").alias("proof_sha256"), folded.alias("folded_root"))
    out = cut(out.withColumn("verified", F.col("folded_root") == F.col("root")))
    drop_cut(*levels, *top_levels)
    return out
