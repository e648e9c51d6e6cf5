"""Connected components of a large set of links, by alternating large-star and small-star steps.

Defined cases: links of a node to itself and links with a null end make no component; repeated links and links in both
directions count as one; an empty table of links gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.session import discard, fresh_path, settle_as


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of ``a`` (the larger ones, or the smaller ones and ``a`` itself) to the least of them."""
    directed = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = directed.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b; longs).

    Each round writes its links to the shared folder, so a lost executor costs one round and lineage stays short; the links of the
    round before go once they are written. A hub
    is never gathered: its minimum is a combining aggregate and its links meet it in a join that splits skewed keys.
    """
    spark = edges.sparkSession
    ends = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    path = fresh_path(spark, "links")
    links = settle_as(ends.distinct(), path)
    stamp = F.struct(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)))
    seen = links.select(stamp).first()[0]
    rounds = 0
    while seen[0] and rounds < max_rounds:
        last, path = path, fresh_path(spark, "links")
        links = settle_as(_star(_star(links, large=True), large=False), path)
        discard(spark, last)
        now = links.select(stamp).first()[0]
        if now == seen:
            break
        seen, rounds = now, rounds + 1
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
