"""Connected components of a link table, distributed: labels fall to the smallest id reachable.

Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond") until nothing changes. A node with very many
neighbours is met by aggregates alone; each round is stored in the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, made_since, mark, place_of, stored


#: Links that one task writes in a round; small tables are written by few tasks.
PER_TASK = 100_000


def _star(edges: DataFrame, large: bool, width: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(width), "least")  # stored: so the join has its own exchanges, which Spark can split
    joined = both.join(low, "a")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with links down has one only, and none up: each link then leads to its component."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("n") > 1)))
    return not odd.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b long): component is the smallest node reachable. Each round lowers labels until none changes; its tables go when the next round's are written."""
    spark = edges.sparkSession
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    width = max(4, -(-now.count() // PER_TASK))  # in proportion to the links
    old = place_of(now)
    while not _are_stars(now):
        number = mark()
        now = stored(_star(_star(now, True, width), False, width).coalesce(width), "edges")
        *inner, new = made_since(number)
        delete(spark, [old, *inner])
        old = new
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
