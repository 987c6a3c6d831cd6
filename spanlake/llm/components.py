"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import released, written
from .common import spread_join


def _below(stars: DataFrame) -> DataFrame:
    return stars.where("u > v").select("u", "v").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _below(spread_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(edges, least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _below(moved.union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(id, component_id)`` per id that has a link; the component is the smallest id reachable.

    Rounds go on until every link leads from an id to the root of its star, about the logarithm of the longest path.  Links
    live in written tables between rounds; hub nodes are dealt over many tasks.  Links of an id with itself or with null
    are ignored.
    """
    now = written(_below(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())))
    while not _stars(now):
        after = written(_small(_large(now)))
        released(now)
        now = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every id is either a root or linked with one root."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()
