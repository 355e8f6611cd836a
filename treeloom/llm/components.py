"""Connected components over a table of links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

#: Links that a task should have at least; a round of few links is not cut into many tasks.
_LINKS_PER_TASK = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a, b).

    Each round links the larger neighbours of every id, and then the smaller
    ones, to the smallest of its neighbourhood (large-star, small-star), until
    every link is from an id to its component; the number of rounds grows with
    the logarithm of the longest chain.  Every grouping is a minimum that is
    combined before the shuffle, and the joins are plain, so AQE can split an id
    with many links.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    tasks = max(8, edges.count() // _LINKS_PER_TASK)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(tasks)
        # Large star: a's larger neighbours get a's minimum.
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)
        large = staged(large, "links")
        release(edges)
        # Small star: a's smaller neighbours and a get a's minimum.
        floor = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(tasks)
        small = large.join(floor.filter("n > 1"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = staged(small.unionByName(floor.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks), "links")
        release(large)
        # Done when every id has one link, and what it links to has none.
        open_ = edges.select("a", F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("a"), F.lit(1).alias("root")).distinct())
        open_ = open_.coalesce(tasks).groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        if open_.isEmpty():
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
