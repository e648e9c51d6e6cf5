"""Carbon intensity of two providers: comparison, attachment to systems, yearly means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.functions.text import folded

MONTH_KEYS = ["country", "year", "month"]


def compare_providers(provider_a: DataFrame, provider_b: DataFrame) -> DataFrame:
    """Both providers side by side, keeping months only one of them has; difference is A - B."""
    return provider_a.join(provider_b, MONTH_KEYS, "full").withColumn(
        "intensity_difference", F.col("intensity_a") - F.col("intensity_b")
    )


def one_zone_per_country(zones: DataFrame, order: str, values: list[str], mean: bool = False) -> DataFrame:
    """Monthly values of a country: those of its first zone in list order, or the mean of its zones."""
    if mean:
        picked = [F.avg(v).alias(v) for v in values]
    else:
        picked = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return zones.groupBy(*MONTH_KEYS).agg(*picked)


def with_intensity(rows: DataFrame, intensity: DataFrame, country: str, month: str, values: list[str]) -> DataFrame:
    """Left join of rows with the month's intensity, on case-folded country and first-of-month date.

    ``intensity`` has one row per (country, month). It is joined without a hint: as a settled table its
    true size is known, so Spark broadcasts it while it is small and otherwise splits skewed countries.
    """
    keyed = intensity.select(
        F.trim(folded(F.col("country"))).alias("_country"),
        F.make_date("year", "month", F.lit(1)).alias("_month"),
        *values,
    )
    on = (F.trim(folded(F.col(country))) == F.col("_country")) & (F.col(month) == F.col("_month"))
    return rows.join(keyed, on, "left").drop("_country", "_month")


def yearly_means(readings: DataFrame, country: str, values: list[str], from_year: int) -> DataFrame:
    """Yearly mean of each source for one country, in year order."""
    return (
        readings.filter((F.col("country") == country) & (F.col("year") >= from_year))
        .groupBy("year")
        .agg(*[F.avg(v).alias(v) for v in values])
        .orderBy("year")
    )
