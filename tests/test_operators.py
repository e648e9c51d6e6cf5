"""Slices, joins, intensity, specs, statistics and reshaping on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetfootprint.operators import fuzzy, intensity, reshape, slicing, specs, stats
from fleetfootprint.schemas import ImpactParams
from fleetfootprint.session import fresh_path
from fleetfootprint.sources.sinks import save_table


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [("a", "FR", "R", "Top500"), ("b", "FR", "I", "Green500"), ("c", None, "R", "Top500"), ("d", "US", None, "Top500")]
    return spark.createDataFrame(rows, "id string, country string, segment string, listing string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_slices(fleet):
    everything = slicing.slice_fleet(fleet, ImpactParams())
    assert ids(everything) == ["a", "b", "c", "d"] and everything.columns == ["id", "segment"]
    assert ids(slicing.slice_fleet(fleet, ImpactParams(country="FR"))) == ["a", "b"]
    assert ids(slicing.slice_fleet(fleet, ImpactParams(segments=("R",)))) == ["a", "c"]
    assert ids(slicing.slice_fleet(fleet, ImpactParams(country="FR", listing="Top500"))) == ["a"]
    assert slicing.slice_fleet(fleet, ImpactParams(country="XX")).isEmpty()


def test_options_and_country_count(fleet):
    assert [r[0] for r in slicing.distinct_options(fleet, "country").collect()] == [None, "FR", "US"]
    assert slicing.count_countries(fleet).first()[0] == 3


def test_providers_outer(spark):
    a = spark.createDataFrame([("FR", 2021, 1, 80.0), ("DE", 2021, 1, 400.0)], "country string, year int, month int, intensity_a double")
    b = spark.createDataFrame([("FR", 2021, 1, 70.0), ("US", 2021, 1, 380.0)], "country string, year int, month int, intensity_b double")
    got = {r["country"]: r["intensity_difference"] for r in intensity.compare_providers(a, b).collect()}
    assert got == {"FR": 10.0, "DE": None, "US": None}


def test_intensity_is_joined_on_folded_country_and_month(spark):
    monthly = spark.createDataFrame([("France ", 2021, 6, 80.0)], "country string, year int, month int, intensity_a double")
    rows = spark.createDataFrame(
        [("x", "FRANCE", dt.date(2021, 6, 1)), ("y", "France", dt.date(2021, 1, 1)), ("z", None, None)],
        "id string, country string, day date",
    )
    got = {r["id"]: r["intensity_a"] for r in intensity.with_intensity(rows, monthly, "country", "day", ["intensity_a"]).collect()}
    assert got == {"x": 80.0, "y": None, "z": None}


def test_first_zone_or_mean(spark):
    zones = spark.createDataFrame(
        [("CA", 2021, 1, 7, 30.0), ("CA", 2021, 1, 6, None), ("CA", 2021, 1, 8, 10.0)],
        "country string, year int, month int, zone_order int, v double",
    )
    assert intensity.one_zone_per_country(zones, "zone_order", ["v"]).first()["v"] == 30.0
    assert intensity.one_zone_per_country(zones, "zone_order", ["v"], mean=True).first()["v"] == 20.0


def test_yearly_means(spark):
    rows = spark.createDataFrame(
        [("FR", 2020, 1.0), ("FR", 2022, 4.0), ("FR", 2022, 6.0), ("FR", 2021, None), ("DE", 2021, 9.0)],
        "country string, year int, v double",
    )
    assert [tuple(r) for r in intensity.yearly_means(rows, "FR", ["v"], 2021).collect()] == [(2021, None), (2022, 5.0)]


SPECS = [("AMD EPYC 7V12 48C 2.45GHz", 240.0), ("Xeon E5-2670 8C", 115.0), ("Xeon Gold 6148 20C", 150.0), ("Unknown Chip 9", None)]


@pytest.fixture(scope="module")
def sheet(spark):
    return spark.createDataFrame(SPECS, "spec_name string, tdp double")


def test_case_folded_join_keeps_rows(spark, sheet):
    rows = spark.createDataFrame([("xeon e5-2670 8c",), ("nothing",), (None,)], "processor string")
    got = {r["processor"]: r["tdp"] for r in specs.join_specs(rows, sheet, "processor", "spec_name").collect()}
    assert got == {"xeon e5-2670 8c": 115.0, "nothing": None, None: None}


@pytest.mark.parametrize("known_keys", [4000, 3, 1])
def test_candidates_do_not_depend_on_what_is_known_of_keys(spark, sheet, monkeypatch, known_keys):
    monkeypatch.setattr(fuzzy, "KNOWN_KEYS", known_keys)
    names = spark.createDataFrame([("AMD 7V12",), ("Xeon E5-2690 8C",), ("Xeon E5-2690 8C",), ("zzz",), (None,)], "name string")
    found = fuzzy.fuzzy_candidates(names, sheet).collect()
    got = {(r["name"], r["spec_name"]): round(r["score"], 4) for r in found}
    assert got[("AMD 7V12", SPECS[0][0])] == 100
    assert got[("Xeon E5-2690 8C", SPECS[1][0])] == 93.3333
    assert {n for n, _ in got} == {"AMD 7V12", "Xeon E5-2690 8C", "zzz"}
    assert len([n for n, _ in got if n == "AMD 7V12"]) == 1


def test_weighted_estimate(spark):
    found = spark.createDataFrame(
        [("n", "p", 100.0), ("n", "q", 90.0), ("n", "r", 95.0), ("m", "r", 80.0)], "name string, spec_name string, score double"
    )
    listed = spark.createDataFrame([("p", 200.0), ("q", 100.0), ("r", None)], "spec_name string, tdp double")
    got = {r["name"]: r for r in fuzzy.weighted_estimates(found, listed, "tdp").collect()}
    assert got["n"]["estimate"] == 169.9 and got["n"]["n_sources"] == 2
    assert got["m"]["estimate"] == 200.0 and got["m"]["n_sources"] == 0
    sources = fuzzy.estimate_sources(found, listed, "tdp").collect()
    assert sorted((r["name"], r["spec_name"], round(r["weight"])) for r in sources) == [("n", "p", 100), ("n", "q", 43)]


def test_fill_keeps_known_and_estimates_the_rest(spark, sheet):
    rows = spark.createDataFrame(
        [(1, "AMD EPYC 7V12 48C 2.45GHz", 3.0), (2, "AMD 7V12", 0.0), (3, "Unknown Chip 9", None), (4, None, None)],
        "id int, processor string, tdp double",
    )
    got = {r["id"]: r["tdp"] for r in specs.fill_missing_tdp(rows, sheet, "processor", "tdp", "spec_name", "tdp").collect()}
    assert got == {1: 3.0, 2: 240.0, 3: 200.0, 4: None}
    always = specs.fill_missing_tdp(rows, sheet, "processor", "tdp", "spec_name", "tdp", F.lit(True))
    assert always.filter("id = 4").first()["tdp"] == 200.0


def test_missing_audit_and_rate(spark):
    rows = spark.createDataFrame([("p", 1.0, None), ("p", 0.0, 2.0), ("q", 5.0, 5.0)], "name string, a double, b double")
    assert [tuple(r) for r in specs.missing_audit(rows, "name", ["a", "b"]).collect()] == [("p", 2, 1, 1)]
    assert tuple(specs.missing_rate(rows, ["a", "b"]).first()) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_outliers_keep_unknown(spark):
    data = [(float(i % 3),) for i in range(30)] + [(1000.0,), (None,), (float("nan"),)]
    got = stats.remove_outliers(spark.createDataFrame(data, "x double"), "x").collect()
    assert len(got) == 32 and not any(r["x"] == 1000.0 for r in got)


def test_constant_column_has_no_outliers(spark):
    assert stats.remove_outliers(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x").count() == 2


def test_growth_curves(spark):
    series = spark.createDataFrame([(0, 8.0), (1, 10.0), (4, 30.0)], "x int, m double")
    got = {r["x"]: r for r in stats.growth_curves(series, "x", "m", start=1, a=1.0, b=0.0).collect()}
    assert got[4]["doubling_4"] == 16.0 and got[4]["doubling_3"] == 20.0 and got[4]["exponential"] == 1.0


def test_sample_is_repeatable(spark):
    df = spark.range(100)
    first = [r["id"] for r in stats.sample_rows(df, "id", 5, seed=1).collect()]
    again = [r["id"] for r in stats.sample_rows(df.repartition(7), "id", 5, seed=1).collect()]
    other = [r["id"] for r in stats.sample_rows(df, "id", 5, seed=2).collect()]
    assert len(set(first)) == 5 and first == again and first != other


def test_reshaping(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, cpu_gwh double, total_carbon_t double")
    assert reshape.select_matching(df, "gwh|id").columns == ["id", "cpu_gwh"]
    assert [tuple(r) for r in reshape.headers(df).collect()] == [(0, "id", 1), (1, "cpu_gwh", 1), (2, "total_carbon_t", 0)]
    long = {tuple(r) for r in reshape.metrics_to_long(df, ["id"], ["cpu_gwh", "total_carbon_t"]).collect()}
    assert long == {(1, "cpu_gwh", 2.0, "energy", "cpu"), (1, "total_carbon_t", None, "carbon", "total")}
    assert reshape.preview_transposed(df, "id").count() == 3
    both = reshape.union_all([df, df.select("id").withColumn("new", F.lit("x"))])
    assert both.columns == ["id", "cpu_gwh", "total_carbon_t", "new"] and both.count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_sinks(spark, fmt):
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "id int, year int")
    path = save_table(df, fresh_path(spark, "test-sink"), fmt, ["year"])
    back = spark.read.schema("id int, year int").format(fmt).option("header", True).load(path)
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2020), (2, 2021)]
