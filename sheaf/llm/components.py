"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import settled


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of the edges and the smallest node it is linked with, over any number of steps.

    A round is one aggregation by node, with map-side combine, and one join whose large side AQE can split, so
    a node with a third of all edges is no bottleneck. The rounds needed grow with the logarithm of the longest
    chain. Each round's edges are a Parquet table in the shared folder; only two sums go to the driver.
    """
    now = settled(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while (state := mark(now)) != seen:
        seen = state
        now = settled(small_star(large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v")).distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()
