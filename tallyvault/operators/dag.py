"""What can be reached in a graph whose nodes are shared: each node once, however many paths lead there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvault.errors import InvalidInventory
from tallyvault.storage import settle

MOST_ROUNDS = 10_000


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node: all that `roots` (node) lead to over `edges` (parent, child), themselves included.

    The frontier moves one edge a round and forgets what was seen, so the rounds are as
    many as the longest shortest path, and work grows with edges, not with paths.
    """
    seen = settle(roots.filter("node is not null").distinct())
    front = seen
    while True:
        met = edges.join(front.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front = settle(met.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front))


def heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and height: 0 without children, else one more than the highest child; refused if there is a cycle."""
    links = settle(edges.select("parent", "child").distinct())
    known = settle(nodes.select("node").distinct().join(links.select(F.col("parent").alias("node")), "node", "left_anti").withColumn("height", F.lit(0)))
    total = nodes.select("node").distinct().count()
    for _ in range(MOST_ROUNDS):
        if known.count() == total:
            return known
        below = links.join(known.withColumnRenamed("node", "child"), "child", "left").groupBy("parent").agg(F.bool_and(F.col("height").isNotNull()).alias("ready"), (F.max("height") + 1).alias("height"))
        new = settle(below.filter("ready").select(F.col("parent").alias("node"), "height").join(known, "node", "left_anti"))
        if new.isEmpty():
            break
        known = settle(known.unionByName(new))
    raise InvalidInventory("the graph has a cycle")
