"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import cut

#: Links below which a round is worked out by windows over nodes: so few fit in any task, and their plan is shorter and has no joins.
FEW = 100_000


def _round_of_few(links: DataFrame) -> DataFrame:
    """A large and a small star by windows over u; rows stay as many or get fewer."""
    of = Window.partitionBy("u")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.withColumn("m", F.least(F.min("v").over(of), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = large.withColumn("m", F.min("v").over(of))
    return small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _with_least(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """``edges`` with the m of their u; the few u with more than ``limit`` edges are sent to all tasks, so no hub gathers in one."""
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(others)


def _round_of_many(links: DataFrame, limit: int) -> DataFrame:
    """The same, in which nodes with more than ``limit`` links are joined by broadcast."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    large = _with_least(both, least, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    small = _with_least(large, least, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(small).where("u <> v").distinct()


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) links of long ids -> (node, root), root the smallest id of the node's component.

    Nodes without any link to another node don't appear. Each round joins every node's links with the smallest of its
    neighbours (large star), then links all smaller neighbours to the smallest (small star); the number of rounds grows
    with the logarithm of the longest chain. A round's links are cut from their lineage in the shared folder.
    Of FEW links or more, nodes with over 1/500 of all (at least 1000, so at most 1000 nodes) are joined by broadcast.
    An empty table gives an empty table; null ends and self-links are ignored.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, count = None, links.count()
    for _ in range(rounds):
        links = cut(_round_of_few(links) if count < FEW else _round_of_many(links, max(1000, count // 500)))
        count, mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (count, mark) == before:
            break
        before = (count, mark)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
