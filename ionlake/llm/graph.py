"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


#: Edges that one task of a round's last stage may get; few edges need few tasks.
EDGES_A_TASK = 200_000


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead to roots: no node has two of them, and none is both ends of different ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not degrees.where("down > 1 or (down = 1 and up = 1)").head(1)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Nulls and loops are left out. Neighbourhoods are only ever aggregated to their minimum, so a node with
    very many links stays a partial aggregate and a join that adaptive execution can split. Each round is
    written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    down = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = scratch.write(down)
    while not _settled(now):
        tasks = 1 + now.count() // EDGES_A_TASK
        after, new = scratch.write(_small_star(_large_star(now)).coalesce(tasks))
        scratch.drop(path)
        now, path = after, new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), (F.col("v")).alias("w")).distinct())
