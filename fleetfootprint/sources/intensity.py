"""Monthly carbon-intensity files of the two providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfootprint.functions.calendar import parse_reading_time
from fleetfootprint.functions.text import normal_country
from fleetfootprint.operators.intensity import one_zone_per_country
from fleetfootprint.schemas import (
    LONG_INTENSITY_AREA_TYPE,
    LONG_INTENSITY_CATEGORY,
    LONG_INTENSITY_SCHEMA,
    LONG_INTENSITY_UNIT,
    ZONE_INTENSITY_SCHEMA,
    ZONE_LIST_SCHEMA,
)


def read_zone_readings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All zone files in one scan, by position: the header spelling varies, the column order does not."""
    rows = spark.read.schema(ZONE_INTENSITY_SCHEMA).option("header", True).csv(paths)
    date = parse_reading_time(F.col("reading_time"))
    return rows.select(
        date.alias("reading_date"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        normal_country(F.col("country")).alias("country"),
        "zone_name",
        "zone_key",
        "direct",
        "life_cycle",
        "low_carbon_pct",
        "renewable_pct",
        "data_source",
    )


def zone_dimension(zones: DataFrame, order: str) -> DataFrame:
    """Countries that have a zone, each (country, zone) once, at its first place in the list."""
    return (
        zones.filter(F.col("zone_key").isNotNull())
        .groupBy(normal_country(F.col("country")).alias("country"), "zone_key")
        .agg(F.min(order).alias(order))
    )


def read_zone_list(spark: SparkSession, path: str) -> DataFrame:
    """Zones in list order: by file, by place of the split in the file, and by row within the split."""
    rows = spark.read.schema(ZONE_LIST_SCHEMA).option("header", True).csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return zone_dimension(rows.select("*", place.alias("zone_order")), "zone_order")


def country_intensity(readings: DataFrame, zones: DataFrame, mean: bool = False) -> DataFrame:
    """Provider A by (country, year, month): countries named as in the zone list, one zone each."""
    listed = readings.drop("country").join(zones, "zone_key")
    values = ["life_cycle", "direct"]
    picked = one_zone_per_country(listed, "zone_order", values, mean)
    return picked.withColumnsRenamed({"life_cycle": "intensity_a", "direct": "intensity_a_direct"})


def filter_long(rows: DataFrame, category: str, unit: str, area_type: str) -> DataFrame:
    """The three predicates on the long table; they reach the scan."""
    return rows.filter(
        (F.col("category") == category) & (F.col("unit") == unit) & (F.col("area_type") == area_type)
    )


def read_long_intensity(spark: SparkSession, path: str) -> DataFrame:
    """Provider B by (country, year, month) from its long-format release."""
    rows = spark.read.schema(LONG_INTENSITY_SCHEMA).option("header", True).csv(path)
    kept = filter_long(rows, LONG_INTENSITY_CATEGORY, LONG_INTENSITY_UNIT, LONG_INTENSITY_AREA_TYPE)
    date = parse_reading_time(F.col("date"))
    return kept.groupBy(
        normal_country(F.col("area")).alias("country"), F.year(date).alias("year"), F.month(date).alias("month")
    ).agg(F.avg("value").alias("intensity_b"))
