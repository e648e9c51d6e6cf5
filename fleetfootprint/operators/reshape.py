"""Column choice by pattern, header lists, wide-to-long and preview shapes, union by name."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name contains a match of ``pattern``."""
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def headers(df: DataFrame) -> DataFrame:
    """Column names of a table in order, with the number of values each column holds."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_values"))
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*entries)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns a frame lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def metrics_to_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per metric, labelled by what it measures and for which component."""
    metric = F.col("metric")
    return df.unpivot(ids, metrics, "metric", "value").withColumns(
        {
            "measure": F.when(metric.contains("gwh"), "energy").otherwise("carbon"),
            "component": F.when(metric.contains("total"), "total")
            .when(metric.contains("cpu"), "cpu")
            .otherwise("gpu"),
        }
    )


def preview_transposed(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First ``n`` rows turned on their side: one row per (row, column) as text."""
    texts = df.orderBy(order).limit(n).select(F.col(order).alias("_id"), *[F.col(c).cast("string") for c in df.columns])
    return texts.unpivot(["_id"], df.columns, "column_name", "value").withColumnRenamed("_id", "row_id")
