"""Connected components of an edge table by alternating large-star and small-star steps, and joins with common keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

#: Steps grow with the logarithm of the longest path; more than this means that something else is wrong.
MOST_STEPS = 100
#: Places in which the rows of a key look up what is known about it, so that none of them gathers a common key.
SALTS = 16


def salted(df: DataFrame, by: str) -> DataFrame:
    """Adds salt, from 0 to SALTS - 1, by the hash of a column."""
    return df.withColumn("salt", F.pmod(F.xxhash64(F.lit(7), by), F.lit(SALTS)).cast("int"))


def at_all_salts(df: DataFrame) -> DataFrame:
    """Every row at every salt: to be joined with salted rows by a key and salt, never by a broadcast, as such tables grow with the input."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """edges has bigint columns a and b. Returns node and root (the smallest node reachable) for nodes with an edge.

    Every step is grouped minima and joins, so no component is gathered in a task or on the driver; the number of steps grows with the
    logarithm of the longest path. Neighbours of a common node (the middle of a star) are salted; in the second half of a step rows
    meet by their larger node, which has a few smaller neighbours only. Each step is written to the shared folder. Raises RuntimeError if the
    steps do not come to an end.
    """
    now = scratch.save(_down(edges), f"{name}-0")
    for step in range(1, MOST_STEPS + 1):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted(both, "b").join(at_all_salts(least), ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = scratch.save(_down(small), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    raise RuntimeError(f"components did not settle in {MOST_STEPS} steps")


def _down(edges: DataFrame) -> DataFrame:
    """Edges once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has at most one smaller neighbour, and none if it has a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()
