"""Two tables compared by digests over ranges of their keys, so that only what differs is shuffled.

A row's digest is a hash of all its compared values, and the digest of a range is the sum of its rows' digests with their number: neither
depends on order or on partitioning. Keys are dealt to leaves by a hash; nodes above fold ``FANOUT`` nodes each, up to the root. Equal
nodes need no look below. Only rows of leaves that differ are joined by their keys.

Two different ranges have equal digests with a probability of about 2**-64. A copy of a row counts, so that a table with
a row twice differs from one that has it once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tierflow.functions.keys import unambiguous
from tierflow.workspace import durable

#: Levels below the root and children of a node, both as bits: 2**16 leaves.
LEVELS, FANOUT = 4, 4
DIGEST = "decimal(38,0)"


def _leaves(df: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: int) -> DataFrame:
    leaf = F.pmod(F.xxhash64(unambiguous(*keys)), F.lit(1 << FANOUT * levels)).alias("_leaf")
    return df.select("*", leaf, F.xxhash64(unambiguous(*keys, *columns)).alias("_digest"))


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """Rows (level, node, n, digest) from the leaves (``levels``) to the root (0). Store it by level, and a later comparison
    reads no row of ``df`` but those of leaves that differ. Partial sums leave a task with a row for each leaf it has."""
    sums = (F.sum("n").alias("n"), F.sum("digest").alias("digest"))
    rows = _leaves(df, keys, columns, levels).select(F.col("_leaf").alias("node"), F.lit(1).cast("long").alias("n"), F.col("_digest").cast(DIGEST).alias("digest"))
    nodes = durable(rows.groupBy("node").agg(sums[0], sums[1].cast(DIGEST).alias("digest")))
    tree = [nodes.withColumn("level", F.lit(levels))]
    for level in range(levels - 1, -1, -1):
        nodes = nodes.withColumn("node", F.shiftright("node", FANOUT)).groupBy("node").agg(sums[0], sums[1].cast(DIGEST).alias("digest"))
        tree.append(nodes.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, tree).select("level", "node", "n", "digest")


def differing_leaves(one: DataFrame, other: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (node) at which two trees differ, found from the root downwards: of each level only the children of
    nodes that differ are compared."""
    found = None
    for level in range(levels + 1):
        sides = [t.where(F.col("level") == level).select("node", "n", "digest") for t in (one, other)]
        if found is not None:
            parents = found.select(F.col("node").alias("parent"))
            sides = [s.join(parents, F.shiftright(s["node"], FANOUT) == F.col("parent"), "left_semi") for s in sides]
        a, b = sides[0].alias("a"), sides[1].alias("b")
        joined = a.join(b, F.col("a.node") == F.col("b.node"), "full")
        same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
        found = durable(joined.where(~same).select(F.coalesce("a.node", "b.node").alias("node")))
        if found.isEmpty():
            break
    return found


def differences(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    levels: int = LEVELS,
    trees: tuple[DataFrame | None, DataFrame | None] = (None, None),
) -> DataFrame:
    """Rows (keys, change): keys that were ``removed``, ``added`` or ``changed`` in a compared value or in their number.

    ``trees`` are stored ones of either table. Null keys are a key like any other."""
    sides = [(df, tree if tree is not None else durable(digest_tree(df, keys, columns, levels))) for df, tree in zip((before, after), trees)]
    leaves = differing_leaves(sides[0][1], sides[1][1], levels).withColumnRenamed("node", "_leaf")

    def folded(df: DataFrame, name: str) -> DataFrame:
        # Leaves that differ are few where tables agree; the scan drops all other rows before any shuffle.
        chosen = _leaves(df, keys, columns, levels).join(leaves, "_leaf", "left_semi")
        return chosen.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.sum(F.col("_digest").cast(DIGEST)).alias("digest")).alias(name))

    a, b = folded(before, "_before"), folded(after, "_after").withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same_key = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    joined = a.join(b, same_key, "full").where(~F.col("_before").eqNullSafe(F.col("_after")))
    change = F.when(F.col("_after").isNull(), "removed").when(F.col("_before").isNull(), "added").otherwise("changed")
    return joined.select(*(F.when(F.col("_before").isNull(), F.col(f"_other_{k}")).otherwise(F.col(k)).alias(k) for k in keys), change.alias("change"))
