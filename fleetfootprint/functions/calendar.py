"""Editions as text, decimal half-years and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edition_label(year: Column, month: Column) -> Column:
    """``YYYY-MM`` tag of an edition."""
    return F.format_string("%d-%02d", year.cast("int"), month.cast("int"))


def label_to_edition(label: Column) -> Column:
    """``YYYY-06`` -> YYYY.0 and ``YYYY-11`` -> YYYY.5."""
    year = F.substring_index(label, "-", 1).try_cast("double")
    return year + F.when(F.substring_index(label, "-", -1) == "11", 0.5).otherwise(0.0)


def date_to_edition(date: Column) -> Column:
    """Half-year that contains the date."""
    return F.year(date) + F.when(F.month(date) >= 7, 0.5).otherwise(0.0)


def edition_to_date(edition: Column) -> Column:
    """YYYY.0 -> 1 January, YYYY.5 -> 1 June."""
    year = F.floor(edition)
    return F.make_date(year.cast("int"), F.floor((edition - year) * 10 + 1.5).cast("int"), F.lit(1))


def month_start(date: Column) -> Column:
    return F.make_date(F.year(date), F.month(date), F.lit(1))


def parse_reading_time(text: Column) -> Column:
    """Readings come as ISO timestamps or day-first ones."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    ).cast("date")
