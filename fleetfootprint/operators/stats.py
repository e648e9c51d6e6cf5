"""Outliers, growth curves and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.functions.growth import doubling_curve, exponential_curve
from fleetfootprint.schemas import Z_THRESHOLD


def remove_outliers(df: DataFrame, column: str, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Drop rows at least ``threshold`` population standard deviations from the mean; unknowns stay.

    Mean and deviation arrive as one scalar subquery.
    """
    value = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    moments = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))).scalar()
    z = F.try_divide(value - moments.getField("mean"), moments.getField("sd"))
    return df.filter(z.isNull() | (F.abs(z) < threshold))


def growth_curves(
    series: DataFrame,
    x: str,
    metric: str,
    start: int = 0,
    a: float = 1.0,
    b: float = 1.0,
) -> DataFrame:
    """Expected growth from the series' own baselines.

    One curve doubles every 4 steps from step 0, one every 3 steps from step ``start``, one is a plain
    exponential. ``x`` numbers the steps from 0.
    """

    def at(step: int):
        return series.filter(F.col(x) == step).agg(F.max(metric)).scalar()

    step = F.col(x).cast("double")
    return series.withColumns(
        {
            "doubling_4": doubling_curve(at(0), step, 4.0),
            "doubling_3": doubling_curve(at(start), step, 3.0, float(start)),
            "exponential": exponential_curve(step, a, b),
        }
    )


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` random rows: the first ones in the order of a keyed hash, so a retried task picks the same."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
