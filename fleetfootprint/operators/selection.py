"""Ranks within editions: the row of one rank by histogram, and the rank of every row by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.session import settle

BUCKETS = 4096
SORTED_ROWS = 100_000
MAX_ROUNDS = 64


def ranked(rows: DataFrame, groups: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Every row with its rank (long, from 1) by ``order`` within ``groups``.

    The whole table is cut by range over groups and order, so a large group has as many pieces as it needs. A rank is the place in the
    piece plus the group's rows in the pieces ahead, of which there is one count per group and piece. Rows that tie in
    ``order`` get different ranks in no set order.
    """
    cut = settle(rows.repartitionByRange(*groups, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    ahead = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_piece").alias("_of_piece"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    inside = Window.partitionBy(*groups, "_piece").orderBy(*order)
    same = F.col("_piece") == F.col("_of_piece")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    placed = cut.withColumn("_place", F.row_number().over(inside)).join(starts, same)
    return placed.withColumn(rank, (F.col("_ahead") + F.col("_place")).cast("long")).select(*rows.columns, rank)


def nth_values(rows: DataFrame, groups: list[str], metric: str, n: int, buckets: int = BUCKETS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The ``metric`` of rank ``n`` by falling metric in each group; groups with fewer known values have no row.

    Counts per group and bucket, combined before the shuffle, tell which bucket holds rank ``n``; its smallest and
    largest value bound the next, finer round. Rows are only sorted once a group's bucket has ``sorted_rows`` or fewer, or not at all where a
    bucket holds one value, so ties of any size cost nothing. NaN counts as unknown.
    """
    value = F.col(metric).cast("double")
    known = settle(rows.filter(value.isNotNull() & ~F.isnan(value)).select(*groups, F.col(metric).alias("_metric"), value.alias("_value")), "values")
    state = settle(
        known.groupBy(*groups)
        .agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.lit(0).cast("long").alias("_ahead"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= n),
        "bounds",
    )
    wide = (F.col("_low") < F.col("_high")) & (F.col("_n") > sorted_rows)
    keys = [F.col(f"_of_{g}") for g in groups]

    def inside(bounds: DataFrame) -> DataFrame:
        named = bounds.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_low", "_high", "_ahead")
        same = F.col("_value").between(F.col("_low"), F.col("_high"))
        for g in groups:
            same = F.col(g).eqNullSafe(F.col(f"_of_{g}")) & same
        return known.join(named, same)

    for _ in range(MAX_ROUNDS):
        if state.filter(wide).isEmpty():
            break
        # halves, for the difference of two huge values is beyond a double
        share = (F.col("_value") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("_bucket")
        counts = (
            inside(state.filter(wide)).groupBy(*keys, "_ahead", bucket)
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        )
        falling = Window.partitionBy(*keys).orderBy(F.desc("_bucket"))
        before = F.col("_ahead") + F.coalesce(F.sum("_n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("_before", before).filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
        finer = found.select(*[F.col(f"_of_{g}").alias(g) for g in groups], "_low", "_high", F.col("_before").alias("_ahead"), "_n")
        state = settle(state.filter(~wide).unionByName(finer), "bounds")
    one = state.filter("_low = _high").select(*groups, "_low")
    # values of one bucket that are equal as doubles may be apart as they are, which the largest stands for
    pinned = inside(one.withColumns({"_high": F.col("_low"), "_ahead": F.lit(0)})).groupBy(*keys).agg(F.max("_metric").alias(metric))
    falling = Window.partitionBy(*keys).orderBy(F.desc("_metric"))
    few = inside(state.filter("_low < _high")).withColumn("_rank", F.row_number().over(falling) + F.col("_ahead")).filter(F.col("_rank") == n)
    return few.select(*[k.alias(g) for k, g in zip(keys, groups)], F.col("_metric").alias(metric)).unionByName(
        pinned.select(*[k.alias(g) for k, g in zip(keys, groups)], metric)
    )
