"""Connected components of an edge list, without bringing links to the driver.

Alternates large-star and small-star steps (Kiveris et al., Connected Components
in MapReduce and Beyond): every node points at the smallest node it knows, until
nothing changes; the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dealt, materialize


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """both: (u, v) for each node u and neighbour v.  Neighbours of u point at the least of them and u.

    A node with many neighbours is dealt over several tasks.
    """
    least = both.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    least = materialize(least.select("u", F.least("u", "least").alias("m"), "n"), "least")
    side = F.col("v") > F.col("u") if larger else F.col("v") < F.col("u")
    found = join_dealt(both.where(side), least, "u", "n", ["v"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        found = found.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return found.where("a <> b")


def _all_stars(pointing: DataFrame) -> bool:
    """Whether every node either points at one other or is only pointed at: then nothing can change any more."""
    ends = pointing.select(F.col("a").alias("n"), F.lit(1).alias("out")).union(pointing.select(F.col("b").alias("n"), F.lit(0).alias("out")))
    mixed = ends.groupBy("n").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)")
    return mixed.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one orderable type.  Returns node, component (its smallest node), for nodes with edges."""
    pointing = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = pointing.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pointing.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, larger=True)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        pointing = materialize(_star(down, larger=False).distinct(), "links")
        if _all_stars(pointing):
            break
    return pointing.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pointing.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
