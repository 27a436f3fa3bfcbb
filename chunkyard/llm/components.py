"""Connected components of a link table, by alternating large-star and small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Links never leave the executors; each round is stored, so that a lost executor
costs that round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import settled, unsized

#: Links for a task, at least; a round stores as many files as it has tasks.
ROWS_A_TASK = 4096


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b), b < a: every larger neighbour of a node is linked to the node's least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Stored, so that the join's sides are dealt apart from the sums and a node with very many links can be split.
    least = settled(both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")).coalesce(tasks))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b), b < a: a and its smaller neighbours are linked to the least of them."""
    least = settled(links.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks))
    moved = links.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Each node that is in a link as `node`, with the least node of its component as `root`.

    links: columns a and b of one orderable type, in any order, repeated or equal.
    """
    now = unsized(settled(links.where("a != b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    seen = None
    while True:
        size = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if size == seen:
            break
        seen, tasks = size, 1 + size[0] // ROWS_A_TASK
        now = settled(_large_star(now.coalesce(tasks), tasks).distinct().coalesce(tasks))
        now = unsized(settled(_small_star(unsized(now), tasks).distinct().coalesce(tasks)))
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
