"""Connected components of a large graph, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, folder: str, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each node's larger
    (then smaller) neighbours are linked to its smallest neighbour, until the graph is a set of
    stars. A step never makes more edges than it read. Each step is written below ``folder``, which
    cuts the lineage, keeps plans small and outlives lost executors; only a count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    current = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    before = None
    for at in range(most_rounds):
        path = f"{folder}/round-{at}"
        large = _large_star(current)
        large.write.parquet(f"{folder}/large-{at}")
        large = spark.read.schema(large.schema).parquet(f"{folder}/large-{at}")
        _small_star(large).write.parquet(path)
        current = spark.read.parquet(path)
        now = current.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the neighbours of a node that are larger than it to the smallest of all of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return linked.unionByName(own).filter("a <> b").distinct()
