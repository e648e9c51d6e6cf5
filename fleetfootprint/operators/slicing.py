"""Parameterised slices of a fleet table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfootprint.schemas import ImpactParams


def slice_condition(params: ImpactParams, with_country: bool = True) -> Column:
    """Predicate of a slice over (country, segment, listing); a parameter that is None lets all rows pass."""
    terms = []
    if with_country and params.country is not None:
        terms.append(F.col("country") == params.country)
    if params.segments is not None:
        terms.append(F.col("segment").isin(*params.segments))
    if params.listing is not None:
        terms.append(F.col("listing") == params.listing)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def slice_fleet(rows: DataFrame, params: ImpactParams) -> DataFrame:
    """Rows of the slice, without the dimensions that were left open at "all"."""
    open_dimensions = []
    if params.country is None:
        open_dimensions.append("country")
    if params.listing is None:
        open_dimensions.append("listing")
    return rows.filter(slice_condition(params)).drop(*open_dimensions)


def distinct_options(rows: DataFrame, column: str) -> DataFrame:
    """Sorted choices of a parameter."""
    return rows.select(column).distinct().orderBy(column)


def count_countries(rows: DataFrame, country: str = "country") -> DataFrame:
    """Number of distinct countries, with a missing country counting as one."""
    return rows.agg(
        (F.count_distinct(country) + F.max(F.col(country).isNull().cast("int"))).alias("n_countries")
    )
