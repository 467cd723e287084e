"""Connected components by alternating stars, with a staged table a round; each round's are deleted by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import release, stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s"),
        F.sum(F.pmod(F.xxhash64("v", "u"), F.lit((1 << 31) - 1))).alias("t"),
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "cc-least")
    out = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
    release(least, edges)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
    release(least, edges)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` links of longs -> ``(node, root)``, root the least node reachable.

    Self links and repeated links are harmless; nulls are dropped; no links give
    an empty table. A node is listed only if it has a link to another node.
    Every round halves the distance to the root at least, so the rounds grow with
    the logarithm of the longest chain; a run past ``max_rounds`` raises.
    """
    edges = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc-edges",
    )
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = _small_star(_large_star(edges))
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
