"""Connected components of an edge list, as joins and aggregations only.

Alternating large-star and small-star steps reach the smallest node of each component in a number of
rounds that grows with the logarithm of the longest path. Neighbourhoods are never collected: each
step takes the smallest neighbour by a (map-side combined) aggregation and joins it back. Every round
ends in a table in the shared folder, so a lost executor costs one round at most. Rounds end when every
edge leads straight to a root.

A star's edges share its centre, so joining them by key would bring them all to one task. `lowest`
therefore joins the heavy keys, those with over 1 / HEAVY_MOST of all rows, as a broadcast table: there
are fewer than HEAVY_MOST of them at any size of input. No task of the other join meets a heavier key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surprisal.llm.common import MADE, discard, materialize

#: Heavy keys number fewer than this, whatever the input, since each has over this part of the rows.
HEAVY_MOST = 1000


def lowest(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows, whose key is never null, with the smallest value among the rows of the same key; rows are read several times."""
    found = materialize(rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("__rows")), "lowest")
    part = (found.agg(F.sum("__rows")).first()[0] or 0) / HEAVY_MOST
    heavy = F.broadcast(found.where(F.col("__rows") > part).drop("__rows"))
    light = found.where(F.col("__rows") <= part).drop("__rows")
    return rows.join(heavy, key).union(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.union(edges.select("b", "a"))
    return lowest(both, "a", "b", "m").where("b > a").selectExpr("b AS a", "least(a, m) AS b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.where("a > b")
    near = lowest(down, "a", "b", "m")
    return near.selectExpr("b AS a", "m AS b").where("a <> b").union(near.where("b = m").select("a", "m"))


def _open(edges: DataFrame) -> bool:
    """Whether some node has two roots, or a root that has one itself."""
    nodes = edges.selectExpr("a AS v", "1 AS roots", "false AS root").union(edges.selectExpr("b", "0", "true"))
    return bool(nodes.groupBy("v").agg(F.sum("roots").alias("n"), F.max("root").alias("r")).where("n > 1 OR (n > 0 AND r)").head(1))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: bigint); root is the smallest node that it reaches."""
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    while _open(now):
        begun = len(MADE)
        now = materialize(_small_star(materialize(_large_star(now).distinct(), "stars")).distinct(), "edges")
        discard(spark, begun - 1, (now,))
    return now.selectExpr("a AS node", "b AS root").union(now.selectExpr("b AS node", "b AS root").distinct())
