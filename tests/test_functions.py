"""Column functions against values worked out by hand."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from fleetfootprint.functions import calendar, growth, power, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_semester_energy(spark):
    idle, full = F.col("idle"), F.col("full")
    row = spark.createDataFrame([(50.0, 1000.0)], "idle double, full double").select(
        *[power.semester_gwh(tau, idle, full).alias(str(i)) for i, tau in enumerate((0.5, 0.65, 0.8))]
    ).first()
    assert list(row) == pytest.approx([0.0022995, 0.00292365, 0.0035478])


def test_age_classes(spark):
    ages = [-0.5, 0.0, 0.25, 0.5, 0.75, 1.0, 4.5, 5.0]
    found = values(spark, [(a,) for a in ages], "age double", power.age_class(F.col("age"), F.lit(5.0)))
    assert found == [None, 0, None, 1, None, 2, 2, None]


def test_first_year_runs_whatever_the_lifespan(spark):
    found = values(spark, [(0.0,), (0.5,), (1.0,)], "age double", power.age_class(F.col("age"), F.lit(0.0)))
    assert found == [0, 1, None]


def test_unit_counts(spark):
    rows = [(100.0, 8.0, 50.0, 3.0), (0.0, 8.0, 50.0, 3.0), (100.0, 0.0, 50.0, 3.0), (100.0, 8.0, None, None), (None, None, 0.0, 1.0)]
    schema = "cores double, per double, tdp double, mult double"
    cols = F.col("cores"), F.col("per"), F.col("tdp")
    assert values(spark, rows, schema, power.unit_count(*cols)) == [12.5, 1.0, 1.0, 12.5, 0.0]
    assert values(spark, rows, schema, power.unit_count(*cols, F.col("mult"))) == [37.5, 1.0, 1.0, 0.0, 0.0]


def test_ratio_repair_and_zero_peak(spark):
    rows = [(80.0, 100.0), (80.0, 10.0), (80.0, 0.0), (None, 5.0)]
    schema = "rmax double, rpeak double"
    peak = power.repaired_rpeak(F.col("rmax"), F.col("rpeak"))
    assert values(spark, rows, schema, peak) == [100.0, 100.0, 0.0, 5.0]
    assert values(spark, rows, schema, power.efficiency_ratio(F.col("rmax"), peak)) == [0.8, 0.8, None, None]
    assert values(spark, rows, schema, power.relative_gap(F.col("rmax"), peak)) == [0.2, 0.2, None, None]


def test_accelerator_flag(spark):
    assert values(spark, [("K20",), (None,)], "a string", power.accel_flag(F.col("a"))) == ["Yes", "No"]


def test_unknown_numbers_count_as_zero(spark):
    assert values(spark, [(1.5,), (None,), (float("nan"),)], "x double", power.zero_if_missing(F.col("x"))) == [1.5, 0, 0]


def test_entity_key_keeps_missing_parts(spark):
    rows = [("C", None, "N", "US", 2015)]
    schema = "computer string, site string, name string, country string, year int"
    key = text.entity_key(*[F.col(c) for c in ("computer", "site", "name", "country", "year")])
    assert values(spark, rows, schema, key) == [hashlib.md5(b"C-nan-N-US-2015").hexdigest()]


def test_country_aliases_match_whole_names(spark):
    rows = [("United States",), ("United States of America",), (" USA ",), ("Korea, South",), ("France",), (None,)]
    found = values(spark, rows, "c string", text.normal_country(F.col("c")))
    usa = "United States of America"
    assert found == [usa, usa, usa, "South Korea", "France", None]


def test_editions(spark):
    labels = [("2015-06",), ("2015-11",), (None,)]
    edition = calendar.label_to_edition(F.col("l"))
    assert values(spark, labels, "l string", edition) == [2015.0, 2015.5, None]
    dates = values(spark, labels, "l string", calendar.edition_to_date(edition))
    assert dates == [dt.date(2015, 1, 1), dt.date(2015, 6, 1), None]
    assert values(spark, [(2015, 6)], "y int, m int", calendar.edition_label(F.col("y"), F.col("m"))) == ["2015-06"]


def test_date_to_edition(spark):
    days = [(dt.date(2015, 6, 30),), (dt.date(2015, 7, 1),)]
    assert values(spark, days, "d date", calendar.date_to_edition(F.col("d"))) == [2015.0, 2015.5]


def test_reading_times_are_day_first(spark):
    texts = [("2021-02-01 00:00:00",), ("01/02/2021 00:00",), ("2021-02-01",), ("?",)]
    day = dt.date(2021, 2, 1)
    assert values(spark, texts, "t string", calendar.parse_reading_time(F.col("t"))) == [day, day, day, None]


def test_growth_curves(spark):
    x = F.col("x")
    rows = [(0.0,), (4.0,), (8.0,)]
    assert values(spark, rows, "x double", growth.doubling_curve(F.lit(10.0), x, 4.0)) == [10.0, 20.0, 40.0]
    assert values(spark, rows, "x double", growth.doubling_curve(F.lit(10.0), x, 4.0, 4.0)) == [5.0, 10.0, 20.0]
    found = values(spark, [(2.0,)], "x double", growth.exponential_curve(x, 3.0, 0.5))
    assert found == pytest.approx([3 * 2.718281828459045])
