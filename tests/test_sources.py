"""Readers on small files of every era, and the whole way from files to the impact series."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from fleetfootprint.plans import fleet as fleet_plans
from fleetfootprint.plans import impact as plans
from fleetfootprint.schemas import ImpactParams
from fleetfootprint.session import settle
from fleetfootprint.sources.intensity import (
    country_intensity,
    read_long_intensity,
    read_zone_list,
    read_zone_readings,
)
from fleetfootprint.sources.lists import edition_paths, read_editions, read_efficiency_lists, read_performance_lists
from fleetfootprint.sources.specs import chip_specs, read_cpu_specs, read_gpu_specs

# fixed values: header lines of the published lists and sheets, here and in the files below
COMMON = "Site,Manufacturer,Computer,Country,Year,Nmax,Nhalf,Processor,Segment,Continent,Name,Accelerator/Co-Processor,Accelerator/Co-Processor Cores"


def system(computer, country="France", year=2015, processor="Xeon E5-2670 8C", segment="Research", accel="", accel_cores="", site="S1"):
    return f"{site},ACME,{computer},{country},{year},1,1,{processor},{segment},Europe,N-{computer},{accel},{accel_cores}"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("lists")

    def write(name, *lines):
        path = root / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    performance = {
        (2008, 6): write("top_200806.csv", f"Rank,{COMMON},Processors,RMax,RPeak", f"1,{system('old')},8,10,20"),
        (2011, 6): write("top_201106.csv", f"Rank,{COMMON},Cores,RMax,RPeak", f"1,{system('mid')},16,10,20"),
        (2015, 6): write(
            "top_201506.csv",
            f"Rank,{COMMON},Total Cores,Rmax,Rpeak",
            f"1,{system('alpha')},160,900,1000",
            f"2,{system('beta', 'Czech Republic', segment='')},80,500,60",
        ),
        # the same era with its columns in another order
        (2015, 11): write(
            "top_201511.csv",
            f"Rpeak,Rmax,Total Cores,{COMMON},Rank",
            f"1000,900,160,{system('alpha')},1",
        ),
        (2017, 11): write("top_201711.csv", f"Rank,{COMMON},Total Cores,Rmax,Rpeak", f"1,{system('gamma', 'USA')},64,7,9"),
        (2019, 6): write(
            "top_201906.csv",
            f"Rank,{COMMON},Total Cores,Rmax [TFlop/s],Rpeak [TFlop/s]",
            f"1,{system('delta', 'United States', 2019, 'xeon gold 6148 20c', accel='nvidia tesla v100', accel_cores=5120)},6000,2,3",
            f"2,{system('gamma', 'USA')},64,1.5,2",
        ),
    }
    green = "Site,Computer,Country,Year,Name,Accelerator/Co-Processor,Accelerator/Co-Processor Cores,Total Cores"
    row = "S1,alpha,France,2015,N-alpha,K20,40,160"
    efficiency = {
        (2014, 6): write("green_2014_06.csv", f"{green},Rmax,Rpeak,Top500_Rank,green500_rank,mflops_per_watt,Power", f"{row},9,10,5,1,4000,3"),
        (2015, 6): write("green_2015_06.csv", f"{green},Rmax,Rpeak,top500_rank,green500_rank,mflops_per_watt,total_power", f"{row},9,10,6,2,5000,4"),
        (2016, 6): write("green_2016_06.csv", f"{green},Rmax,Rpeak,Top500_Rank,Green500_Rank,Mflops/Watt,Power", f"{row},9,10,7,3,6000,5"),
        (2016, 11): write("green_2016_11.csv", f"{green},Rmax,Rpeak,Rank,Green500_Rank,Mflops/Watt,Power", f"{row},9,10,8,4,7000,6"),
        (2018, 6): write("green_2018_06.csv", f"{green},Rmax [TFlop/s],Rpeak [TFlop/s],TOP500 Rank,Rank,Power Effeciency [GFlops/Watts],Power (kW)", f"{row},9,10,9,5,8,7"),
        (2020, 11): write("green_2020_11.csv", f"{green},Rmax [TFlop/s],Rpeak [TFlop/s],TOP500 Rank,Rank,Power Efficiency [GFlops/Watts],Power (kW)", f"{row},9,10,10,6,9,8"),
        (2022, 6): write("green_2022_06.csv", f"{green},Rmax [TFlop/s],Rpeak [TFlop/s],TOP500 Rank,Rank,Energy Efficiency [GFlops/Watts],Power (kW)", f"{row},9,10,11,7,10,9"),
    }
    lower = "Zone name,Zone id,Carbon intensity gCO2eq/kWh (direct),Carbon intensity gCO2eq/kWh (Life cycle),CFE%,RE%,Data source"
    upper = "Zone Name,Zone Id,Carbon Intensity gCO2eq/kWh (direct),Carbon Intensity gCO2eq/kWh (LCA),Low Carbon Percentage,Renewable Percentage"
    zones = [
        write("FR_2015_monthly.csv", f"Datetime (UTC),Country,{upper},Data Source", "2015-01-01 00:00:00,France,France,FR,40,80,90,20,x", "2015-06-01 00:00:00,France,France,FR,41,81,90,20,x"),
        write("US-A_2019_monthly.csv", f"Datetime (UTC),Country,{lower}", "01/01/2019 00:00,USA,West,US-A,300,390,1,1,y", "01/06/2019 00:00,USA,West,US-A,310,400,1,1,y"),
        write("US-B_2019_monthly.csv", f"Datetime (UTC),Country,{upper}", "01/01/2019 00:00,USA,East,US-B,500,590,1,1"),
    ]
    return {
        "performance": performance,
        "efficiency": efficiency,
        "zones": zones,
        "zone_list": write("zones.csv", "Country,ZoneKey,", "Argentina,,none", "United States,US-B,", "United States,US-A,", "France,FR,", "France,FR,again"),
        "long": write(
            "long.csv",
            "Area,Country code,Date,Area type,Continent,Category,Subcategory,Variable,Unit,Value",
            "France,FRA,2015-01-01,Country,Europe,Power sector emissions,CO2 intensity,CO2 intensity,gCO2/kWh,60.5",
            "France,FRA,2015-01-01,Country,Europe,Power sector emissions,Total,Total,mtCO2,9",
            "Europe,,2015-01-01,Region,Europe,Power sector emissions,CO2 intensity,CO2 intensity,gCO2/kWh,300",
            "Korea,KOR,2015-01-01,Country,Asia,Capacity,x,x,gCO2/kWh,1",
        ),
        "cpu": write(
            "cpu.csv",
            "Processor,Manufacturer,Family,Model,Cores,base_clock_speed,TDP,num_cores,Source,",
            "Xeon E5-2670 8C,Intel,,E5,8C,2.6GHz,115,8,web,",
            "Xeon Gold 6148 20C,Intel,Gold,6148,20C,2.4GHz,150,20,web,",
        ),
        "gpu": write(
            "gpu.csv",
            "GPU Model,GPU_TDP,n_shaders,n_SM,deuxieme_GPU_TDP,deuxieme_n_shaders,deuxieme_n_SM,Notes",
            "NVIDIA Tesla V100,300,5120,80,,,,",
            "Deep Chip,,,,,,,No data",
        ),
    }


def test_performance_eras(spark, files):
    got = {(r["rank_year"], r["computer"]): r for r in read_performance_lists(spark, files["performance"]).collect()}
    assert len(got) == 8
    assert got[("2008-06", "old")]["cores"] == 8 and got[("2011-06", "mid")]["cores"] == 16
    alpha = got[("2015-06", "alpha")]
    assert (alpha["cores"], alpha["rmax"], alpha["rpeak"], alpha["perf_ratio"]) == (160, 900, 1000, 0.9)
    moved = got[("2015-11", "alpha")]
    assert (moved["cores"], moved["rmax"], moved["rpeak"], moved["rank"], moved["edition"]) == (160, 900, 1000, 1, 2015.5)
    beta = got[("2015-06", "beta")]
    assert beta["rpeak"] == 600 and beta["country"] == "Czechia" and not beta["accel_present"]
    assert got[("2017-11", "gamma")]["rmax"] == 7000 and got[("2019-06", "delta")]["rpeak"] == 3000
    assert alpha["entity_id"] == moved["entity_id"] != beta["entity_id"]


def test_lists_are_cut_at_n(spark, files):
    assert read_performance_lists(spark, files["performance"], n=1).count() == 6


def test_efficiency_eras(spark, files):
    got = {r["rank_year"]: r for r in read_efficiency_lists(spark, files["efficiency"]).collect()}
    assert [got[e]["top_rank"] for e in sorted(got)] == [5, 6, 7, 8, 9, 10, 11]
    assert [got[e]["rank"] for e in sorted(got)] == [1, 2, 3, 4, 5, 6, 7]
    assert [got[e]["gflops_per_watt"] for e in sorted(got)] == pytest.approx([4, 5, 6, 7, 8, 9, 10])
    assert [got[e]["power_kw"] for e in sorted(got)] == [3, 4, 5, 6, 7, 8, 9]
    assert [got[e]["rmax"] for e in sorted(got)] == [9, 9, 9, 9, 9000, 9000, 9000]
    assert all(r["accel_present"] and r["listing"] == "Green500" for r in got.values())


def test_specs(spark, files):
    chips = chip_specs(read_cpu_specs(spark, files["cpu"]), read_gpu_specs(spark, files["gpu"]))
    assert {(r["type"], r["processor"] or r["gpu_model"]) for r in chips.collect()} == {
        ("CPU", "Xeon E5-2670 8C"), ("CPU", "Xeon Gold 6148 20C"), ("GPU", "NVIDIA Tesla V100"), ("GPU", "Deep Chip"),
    }
    assert "blank" not in chips.columns


def test_intensity(spark, files):
    readings = read_zone_readings(spark, files["zones"])
    assert {r["reading_date"] for r in readings.filter("zone_key = 'US-A'").collect()} == {dt.date(2019, 1, 1), dt.date(2019, 6, 1)}
    zones = read_zone_list(spark, files["zone_list"])
    assert sorted((r["country"], r["zone_key"]) for r in zones.collect()) == [
        ("France", "FR"), ("United States of America", "US-A"), ("United States of America", "US-B"),
    ]
    monthly = {(r["country"], r["month"]): r["intensity_a"] for r in country_intensity(readings, zones).collect()}
    # East stands first in the list; June only has the other zone
    assert monthly[("United States of America", 1)] == 590 and monthly[("United States of America", 6)] == 400
    mean = country_intensity(readings, zones, mean=True).filter("month = 1 and year = 2019").first()
    assert mean["intensity_a"] == 490
    assert [tuple(r) for r in read_long_intensity(spark, files["long"]).collect()] == [("France", 2015, 1, 60.5)]


@pytest.fixture(scope="module")
def built(spark, files):
    editions = read_editions(spark, files["performance"], files["efficiency"])
    zones = read_zone_list(spark, files["zone_list"])
    provider_a = country_intensity(read_zone_readings(spark, files["zones"]), zones)
    monthly = fleet_plans.electricity(provider_a, read_long_intensity(spark, files["long"]))
    fleet = fleet_plans.build_fleet(
        editions, read_cpu_specs(spark, files["cpu"]), read_gpu_specs(spark, files["gpu"]), monthly
    )
    return settle(editions, "editions"), settle(fleet, "fleet")


def test_fleet_table(built):
    editions, fleet = built
    rows = fleet.collect()
    assert len(rows) == editions.count() == 15
    alpha = [r for r in rows if r["computer"] == "alpha"]
    assert len(alpha) == 9 and {r["final_edition"] for r in alpha} == {2022.0} and {r["lifespan"] for r in alpha} == {7.0}
    # the efficiency list knows no processor: it is filled from the performance list, and the spec follows
    assert {r["cpu_tdp"] for r in alpha} == {115.0} and {r["processor"] for r in alpha} == {"Xeon E5-2670 8C"}
    top = next(r for r in alpha if r["listing"] == "Top500" and r["edition"] == 2015.0)
    assert top["num_cpus"] == 20.0 and top["intensity_a"] == 80.0 and top["intensity_b"] == 60.5
    delta = next(r for r in rows if r["computer"] == "delta")
    assert (delta["cpu_tdp"], delta["gpu_tdp"], delta["num_gpus"], delta["num_cpus"]) == (150.0, 300.0, 80.0, 44.0)
    assert delta["country"] == "United States of America" and delta["intensity_a"] == 590
    assert {r["exit_reason"] for r in rows} == {"Removed"}
    # an accelerator without a name gets the default, a system without one gets none
    assert {r["gpu_tdp"] for r in alpha if r["listing"] == "Green500"} == {200.0} and top["gpu_tdp"] is None
    beta = next(r for r in rows if r["computer"] == "beta")
    assert beta["segment"] == "Unknown" and beta["gpu_tdp"] is None


def test_impact_of_built_fleet(built):
    editions, fleet = built
    limits = fleet_plans.fleet_thresholds(editions)
    got = {r["semester"]: r for r in plans.impact(fleet, limits, ImpactParams(country="France")).collect()}
    assert len(got) == 25
    # alpha: 20 CPUs of 115 W, installed 2015, seen until 2022; old and mid left before they were installed
    full, idle = 20 * 115.0, 57.5
    assert got[2016.0]["cpu_gwh"] == pytest.approx(730 * (0.2 * idle + 0.8 * full) / 1e9 * 6)
    assert got[2016.0]["cpu_carbon_t"] == pytest.approx(got[2016.0]["cpu_gwh"] * 80)
    assert got[2021.5]["active_systems"] == 1 and got[2022.0]["active_systems"] == 0


def test_minimal_view(built):
    view = fleet_plans.minimal_view(built[1], "entity_id", "row_seq", ["computer", "cpu_tdp", "intensity_b"], "edition")
    alpha = view.filter(F.col("computer") == "alpha").first()
    assert alpha["editions"] == [2014.0, 2015.0, 2015.5, 2016.0, 2016.5, 2018.0, 2020.5, 2022.0]
    assert alpha["intensity_b"] == 60.5


def test_lists_as_spark_writes_them(spark, files, tmp_path):
    """Folders, compressed files and names with spaces; the edition comes from the key, not from the file name."""
    raw = spark.read.option("header", True).csv(files["performance"][(2015, 6)])
    folder, zipped, named = (str(tmp_path / name) for name in ("any folder", "part.csv", "top_201506.csv.gz"))
    raw.write.parquet(folder)
    assert {r["rank_year"] for r in read_performance_lists(spark, {(2015, 6): folder}, fmt="parquet").collect()} == {"2015-06"}
    raw.repartition(2).write.option("header", True).option("compression", "gzip").csv(zipped)
    later = {(2015, 11): zipped, (2015, 6): files["performance"][(2015, 6)]}
    got = read_performance_lists(spark, later).groupBy("rank_year").count().collect()
    assert sorted(map(tuple, got)) == [("2015-06", 2), ("2015-11", 2)]
    with gzip.open(named, "wt") as out:
        out.write(open(files["performance"][(2015, 6)]).read())
    found = edition_paths(spark, str(tmp_path), (2015, 6), (2015, 11))
    assert list(found) == [(2015, 6)] and read_performance_lists(spark, found).count() == 2
    assert edition_paths(spark, str(tmp_path), (2016, 6), (2020, 11)) == {}


def test_strange_editions_are_errors(spark, files):
    path = files["efficiency"][(2014, 6)]
    with pytest.raises(ValueError, match="outside"):
        read_efficiency_lists(spark, {(1980, 6): path, (2014, 6): path})
    with pytest.raises(ValueError, match="not in the header"):
        read_efficiency_lists(spark, {(2020, 6): path})
    with pytest.raises(ValueError, match="no edition"):
        read_performance_lists(spark, {})


def test_early_efficiency_lists(spark, tmp_path):
    path = tmp_path / "green_2010_11.csv"
    path.write_text("Site,Computer,Country,Year,Name,Cores,RMax,RPeak,TOP500 Rank,Rank,Power Effeciency [GFlops/Watts],Power\nS,c,France,2009,n,8,9,10,1,2,3,4\n")
    row = read_efficiency_lists(spark, {(2010, 11): str(path)}).first()
    assert (row["cores"], row["rmax"], row["rank"], row["gflops_per_watt"], row["edition"]) == (8, 9, 2, 3, 2010.5)


def test_fleet_of_efficiency_lists_alone(spark, files):
    editions = read_editions(spark, {}, files["efficiency"])
    systems = fleet_plans.computers(editions, max_edition=2024.5)
    assert systems.count() == 7 and {r["segment"] for r in systems.collect()} == {"Unknown"}
    chips = fleet_plans.chips(systems, read_cpu_specs(spark, files["cpu"]), read_gpu_specs(spark, files["gpu"]))
    assert chips.count() == 7


def test_last_rank_follows_the_lists(spark, files):
    editions = read_editions(spark, files["performance"], {}, n=2)
    kept = fleet_plans.computers(editions, max_edition=2024.5, last_rank=2, keep_active=True)
    assert fleet_plans.fleet_thresholds(editions, last_rank=2).count() == 2 and kept.count() == 8
