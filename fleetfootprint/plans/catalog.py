"""The operators applied to the driver's tables.

Analogy: system = customer, list edition = half-year of the order date, metric = order price, listing =
order status, segment = market segment, country = nation, chip specification = part, provider A and B =
monthly means of line-item and order prices by nation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfootprint.functions.calendar import (
    date_to_edition,
    edition_label,
    edition_to_date,
    label_to_edition,
    month_start,
    parse_reading_time,
)
from fleetfootprint.functions.power import (
    accel_flag,
    efficiency_ratio,
    relative_gap,
    repaired_rpeak,
    semester_gwh,
)
from fleetfootprint.functions.text import entity_key, normal_country, null_if, unknown_if_missing
from fleetfootprint.operators.expansion import churn, expand_semesters
from fleetfootprint.operators.fill import first_non_null, group_fill, scan_fill
from fleetfootprint.operators.fuzzy import best_match, estimate_sources, fuzzy_candidates, weighted_estimates
from fleetfootprint.operators.intensity import compare_providers, with_intensity, yearly_means
from fleetfootprint.operators.lifecycle import (
    presence_history,
    rank_thresholds,
    top_per_edition,
    with_exit_reason,
    with_presence,
)
from fleetfootprint.operators.presence import list_turnover, presence_bits
from fleetfootprint.operators.reshape import headers, preview_transposed, select_matching, union_all
from fleetfootprint.operators.slicing import distinct_options, slice_fleet
from fleetfootprint.operators.selection import nth_values, ranked
from fleetfootprint.operators.skew import hot_keys
from fleetfootprint.operators.specs import (
    fill_missing_tdp,
    join_specs,
    missing_audit,
    missing_rate,
    with_unit_counts,
)
from fleetfootprint.operators.stats import growth_curves, remove_outliers, sample_rows
from fleetfootprint.plans import fleet as fleet_plans
from fleetfootprint.plans import cube as cubes
from fleetfootprint.plans import impact as plans
from fleetfootprint.plans.fleet import minimal_view
from fleetfootprint.schemas import EFFICIENCY_LISTING, PERFORMANCE_LISTING, Era, ImpactParams
from fleetfootprint.session import fresh_path, settle
from fleetfootprint.sources.intensity import country_intensity, filter_long, zone_dimension
from fleetfootprint.sources.lists import era_value, read_lists
from fleetfootprint.sources.sinks import save_table

# Parameters of the analogy.
SPAN = (1995.0, 2002.0)
MAX_EDITION = 2001.5
LISTED = 500
THRESHOLD_RANK = 100
THRESHOLD_LISTING = "O"
COUNTRY = "NATION_3"
BASE = ImpactParams(span=SPAN, time_after_drop=2.0)
COUNTRY_SLICE = ImpactParams(
    span=SPAN, time_after_drop=2.0, country=COUNTRY, segments=("AUTOMOBILE", "BUILDING", "MACHINERY"), listing=None
)
ERAS = (
    Era(1995.0, 1997.0, {"cores": ("o_custkey", 1), "rmax": ("o_totalprice", 1)}),
    Era(1997.0, 1999.0, {"cores": ("o_orderkey", 1), "rmax": ("o_totalprice", 1)}),
    Era(1999.0, 9999.0, {"cores": ("o_orderkey", 1), "rmax": ("o_totalprice", 1000)}),
)
LINE_ERAS = (
    Era(1995.0, 1997.5, {"speed": ("l_quantity", 1)}),
    Era(1997.5, 2000.0, {"speed": ("l_extendedprice", 0.001)}),
    Era(2000.0, 9999.0, {"speed": ("l_extendedprice", 1000)}),
)
ALIASES = {"NATION_1": "First Nation", "NATION_2": "NATION_20", "NATION_20": "NATION_20"}
ENERGY = ("cpu_gwh", "gpu_gwh", "total_gwh")
CARBON = ("cpu_carbon_t", "gpu_carbon_t", "total_carbon_t")
TURNOVER = ("systems_added", "systems_removed", "active_systems", "total_systems")


TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table under its known schema, so no job is spent on reading footers."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def hundredths(amount: Column) -> Column:
    """Whole hundredths; sums of them are exact."""
    return F.floor(amount * 100 + 0.5)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_impact(df: DataFrame) -> DataFrame:
    """Energy is a multiple of 1e-10 GWh with whole watts, so it is rounded to that; carbon to 1e-4 t."""
    df = rounded(df, 10, *[c for c in df.columns if c.endswith("_gwh")])
    return rounded(df, 4, *[c for c in df.columns if c.endswith("carbon_t")])


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their edition and its label."""
    day = F.col("o_orderdate")
    label = edition_label(F.year(day), F.when(F.month(day) >= 7, 11).otherwise(6))
    return table(spark, sf_dir, "orders").withColumns({"edition": date_to_edition(day), "rank_year": label})


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer key with segment and country."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("country"), "c_nationkey")
    )


def since(moment: Column, year: int | None) -> Column:
    """Readings from the start of a year on; reaches the scan."""
    return F.lit(True) if year is None else moment >= F.lit(dt.datetime(year, 1, 1)).cast("timestamp_ntz")


def provider_a(spark: SparkSession, sf_dir: str, country: str | None = None, from_year: int | None = None) -> DataFrame:
    """Monthly means by the supplier's nation; whole cents, summed per supplier first, so sums are exact.

    With a country, only its suppliers' lines are aggregated.
    """
    nation = table(spark, sf_dir, "nation").filter(F.lit(True) if country is None else F.col("n_name") == country)
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf_dir, "lineitem").filter(since(F.col("l_shipdate"), from_year))
    if country is not None:
        lines = lines.join(suppliers.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    cents = hundredths(F.col("l_extendedprice"))
    percent_paid = 100 - hundredths(F.col("l_discount"))
    per_supplier = (
        lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
        .agg(
            F.sum(cents).alias("_life"),
            F.sum(cents * percent_paid).alias("_direct"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    n = F.sum("_n") * 10_000.0
    return (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("n_name").alias("country"), "year", "month")
        .agg(
            (F.sum("_life") / n).alias("intensity_a"),
            (F.sum("_direct") / (n * 100)).alias("intensity_a_direct"),
        )
    )


def provider_b(spark: SparkSession, sf_dir: str, country: str | None = None, from_year: int | None = None) -> DataFrame:
    """Monthly means by the customer's nation, summed per customer first; with a country, only its customers' orders."""
    buyers = customers(spark, sf_dir).filter(F.lit(True) if country is None else F.col("country") == country)
    orders = table(spark, sf_dir, "orders").filter(since(F.col("o_orderdate"), from_year))
    if country is not None:
        orders = orders.join(buyers.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    per_customer = (
        orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
        .agg(F.sum(hundredths(F.col("o_totalprice"))).alias("_cents"), F.count(F.lit(1)).alias("_n"))
    )
    return (
        per_customer.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("country", "year", "month")
        .agg((F.sum("_cents") / (F.sum("_n") * 60_000.0)).alias("intensity_b"))
    )


def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_providers(provider_a(spark, sf_dir), provider_b(spark, sf_dir))


def fleet(spark: SparkSession, sf_dir: str, with_carbon: bool = True) -> DataFrame:
    """The wide fleet table: one row per order, with its customer, chips and the month's intensity."""
    price = F.floor("o_totalprice")
    priority = F.col("o_orderpriority")
    rows = (
        editions(spark, sf_dir)
        .join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("entity_id"),
            ((F.col("edition") * 2).cast("long") * 2**46 + F.col("o_orderkey")).alias("row_seq"),
            "o_orderkey",
            "edition",
            edition_to_date(F.col("edition")).alias("year_month"),
            F.year("o_orderdate").cast("double").alias("installation_year"),
            "country",
            "segment",
            F.col("o_orderstatus").alias("listing"),
            F.col("o_totalprice").alias("metric"),
            F.when(priority != "5-LOW", (90 + price % 200).cast("double")).alias("cpu_tdp"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), (250 + price % 150).cast("double")).alias("gpu_tdp"),
            (1 + F.col("o_orderkey") % 64).cast("double").alias("num_cpus"),
            (F.col("o_orderkey") % 8).cast("double").alias("num_gpus"),
        )
    )
    if not with_carbon:
        return rows.withColumns({"intensity_a": F.lit(1.0), "intensity_b": F.lit(1.0)})
    monthly = settle(intensity(spark, sf_dir), "intensity")
    return with_intensity(rows, monthly, "country", "year_month", ["intensity_a", "intensity_b"])


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = top_per_edition(
        editions(spark, sf_dir).filter(F.col("o_orderstatus") == THRESHOLD_LISTING),
        ["edition"],
        [F.col("o_totalprice").desc(), F.col("o_orderkey")],
        THRESHOLD_RANK,
    )
    return rank_thresholds(ranked, "rank", THRESHOLD_RANK, "edition", "o_totalprice")


# ---- the same way as from files ------------------------------------------------------------------


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its rank in a list: open ones make the performance list of their edition, the others the efficiency list."""
    lead = (
        table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("p_brand").alias("p_brand"), F.min("p_type").alias("p_type"))
    )
    key, brand = F.col("o_orderkey"), F.col("p_brand")
    is_open = F.col("o_orderstatus") == THRESHOLD_LISTING
    orders = editions(spark, sf_dir).withColumn("listing", F.when(is_open, PERFORMANCE_LISTING).otherwise(EFFICIENCY_LISTING))
    placed = ranked(orders, ["edition", "listing"], [F.col("o_totalprice").desc(), key])
    rows = placed.join(lead, "o_orderkey", "left").join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    accel = F.when(key % 3 == 0, F.col("p_type"))
    return rows.select(
        "o_orderkey",
        F.col("o_custkey").alias("entity_id"),
        "edition",
        "listing",
        "rank",
        F.col("o_totalprice").alias("rmax"),
        F.year("o_orderdate").alias("year"),
        F.upper("country").alias("country"),
        null_if(F.col("segment"), "MACHINERY").alias("segment"),
        F.when(key % 4 == 1, F.upper(brand)).when(key % 4 > 1, brand).alias("processor"),
        accel.alias("accel_name"),
        accel.isNotNull().alias("accel_present"),
        F.floor("o_totalprice").alias("cores"),
        F.when(accel.isNotNull(), F.floor(F.col("o_totalprice") / 2)).alias("accel_cores"),
        (
            F.when(is_open, 0).otherwise(1).cast("long") * 2**61
            + (F.col("edition") * 2).cast("long") * 2**46
            + F.col("rank")
        ).alias("row_seq"),
    )


def chip_sheets(spark: SparkSession, sf_dir: str, missing: str = "") -> tuple[DataFrame, DataFrame]:
    """CPU sheet by brand and GPU sheet by type, without the type ``missing``."""
    parts = table(spark, sf_dir, "part")
    size = F.max("p_size")
    cpus = parts.groupBy(F.col("p_brand").alias("processor")).agg(
        size.cast("double").alias("tdp"), (size * 2).cast("int").alias("num_cores")
    )
    gpus = parts.filter(F.col("p_type") != missing).groupBy(F.col("p_type").alias("gpu_model")).agg(
        (size * 10).cast("double").alias("gpu_tdp"), (size * 100).cast("int").alias("n_shaders"), size.cast("int").alias("n_sm"),
        F.lit(None).cast("double").alias("second_gpu_tdp"),
    )
    return cpus, gpus


def _labelled(systems: DataFrame) -> DataFrame:
    return systems.select(
        "o_orderkey", "entity_id", "edition", "listing", "rank", F.size("editions").cast("long").alias("n_editions"),
        "n_appearances", "final_edition", "threshold", "exit_reason", "installation_year", "lifespan", "segment", "metric",
    )


def q_computers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(fleet_plans.computers(listed(spark, sf_dir), "rmax", MAX_EDITION, last_rank=THRESHOLD_RANK))


def q_exit_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = fleet_plans.computers(listed(spark, sf_dir), "rmax", MAX_EDITION, last_rank=THRESHOLD_RANK, keep_active=True)
    return _labelled(systems)


CHIP_COLUMNS = ("cpu_tdp", "cpu_num_cores", "gpu_tdp", "n_shaders", "n_sm", "second_gpu_tdp")


def q_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fleet_plans.chips(listed(spark, sf_dir), *chip_sheets(spark, sf_dir, missing="PROMO"))
    return joined.select("o_orderkey", "entity_id", "processor", "accel_name", *CHIP_COLUMNS)


def q_gpu_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accelerators without a power value: estimated from the sheet by names that are written in several ways."""
    watts = (100 + F.count(F.lit(1)) % 397).cast("double").alias("gpu_tdp")
    gpus = table(spark, sf_dir, "part").filter("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("gpu_model")).agg(watts)
    name, step = F.col("accel_name"), F.col("o_orderkey") % 9
    written = (
        F.when(step == 0, name)
        .when(step == 3, F.concat(name, F.lit(" X"), (F.col("o_orderkey") % 7).cast("string")))
        .otherwise(F.concat(F.lit("MARK "), F.translate(name, "AE", "E"), F.lit(" "), (F.col("o_orderkey") % 5).cast("string")))
    )
    known = F.when((name == "ECONOMY") & (step == 0), F.lit(55.0))
    parts = listed(spark, sf_dir).withColumns({"gpu_tdp": known, "accel_name": written})
    filled = fill_missing_tdp(parts, gpus, "accel_name", "gpu_tdp", "gpu_model", "gpu_tdp", F.col("accel_present"))
    return filled.select("o_orderkey", "accel_name", "gpu_tdp")


def zone_readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Readings by zone and month, and the zone list: a nation's suppliers make up three zones."""
    nation = table(spark, sf_dir, "nation")
    zone = F.concat_ws("-", "n_name", F.col("s_suppkey") % 3)
    suppliers = (
        table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", zone.alias("zone_key"), F.col("n_name").alias("country"))
    )
    per_supplier = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
        .agg(F.sum(hundredths(F.col("l_extendedprice"))).alias("_cents"), F.sum(hundredths(F.col("l_quantity"))).alias("_units"), F.count(F.lit(1)).alias("_n"))
    )
    readings = (
        per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("zone_key", "country", "year", "month")
        .agg((F.sum("_cents") / (F.sum("_n") * 100.0)).alias("life_cycle"), (F.sum("_units") / (F.sum("_n") * 100.0)).alias("direct"))
    )
    return readings, zone_dimension(suppliers.withColumnRenamed("s_suppkey", "zone_order"), "zone_order")


def q_country_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, zones = zone_readings(spark, sf_dir)
    first = country_intensity(readings, zones)
    mean = country_intensity(readings, zones, mean=True).withColumnsRenamed({"intensity_a": "mean_a", "intensity_a_direct": "mean_direct"})
    both = first.join(mean, ["country", "year", "month"])
    return rounded(both, 6, "intensity_a", "intensity_a_direct", "mean_a", "mean_direct").withColumns({c: F.col(c).cast("long") for c in ("year", "month")})


def q_build_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    cpus, gpus = chip_sheets(spark, sf_dir)
    monthly = fleet_plans.electricity(country_intensity(*zone_readings(spark, sf_dir)), provider_b(spark, sf_dir))
    built = fleet_plans.build_fleet(listed(spark, sf_dir), cpus, gpus, monthly, "rmax", MAX_EDITION, THRESHOLD_RANK)
    chosen = built.select(
        "o_orderkey", "entity_id", "edition", "final_edition", "exit_reason", "lifespan", "processor", "accel_name", "num_cpus",
        "num_gpus", "cpu_tdp", "gpu_tdp", *fleet_plans.INTENSITIES,
    )
    return rounded(chosen, 6, *fleet_plans.INTENSITIES)


# ---- loading and normalising ---------------------------------------------------------------------


def q_edition_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_per_edition(
        editions(spark, sf_dir), ["edition"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], LISTED
    )
    key = entity_key(
        F.col("o_custkey"), null_if(F.col("o_orderpriority"), "5-LOW"), F.col("o_orderstatus"), F.year("o_orderdate")
    )
    return top.select(
        "o_orderkey",
        "rank_year",
        label_to_edition(F.col("rank_year")).alias("edition"),
        F.col("rank").cast("long").alias("rank"),
        era_value(F.col("edition"), ERAS, "cores").alias("cores"),
        era_value(F.col("edition"), ERAS, "rmax").alias("rmax"),
        key.alias("entity_key"),
        F.lit("orders").alias("listing"),
    )


LIST_HEADER = "Rank,Site,Manufacturer,Computer,Country,Year,Nmax,Nhalf,Processor,Segment,Continent,Name,Accelerator/Co-Processor,Accelerator/Co-Processor Cores"
LIST_YEARS = 10


def write_lists(spark: SparkSession, sf_dir: str) -> str:
    """The first 500 orders of each edition as ranking lists, ten years later: the old ones with a title, a header per era."""
    top = top_per_edition(editions(spark, sf_dir), ["edition"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], LISTED)
    at = F.col("edition") + LIST_YEARS
    price = F.col("o_totalprice").cast("string")
    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""x"""'))
    cells = [
        F.col("rank"), F.lit("S1"), F.lit("ACME"), F.col("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "USA").otherwise("France"), F.year("o_orderdate"), F.lit("n/a"),
        F.lit(""), quoted, F.col("o_orderstatus"), F.lit("Europe"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "K20").otherwise(""), F.lit(""),
        F.col("o_custkey"), price, F.concat(price, F.lit("0")),
    ]
    rows = top.select(at.alias("at"), F.col("rank").alias("line"), F.concat_ws(",", *[c.cast("string") for c in cells]).alias("value"))
    lists = top.select(at.alias("at")).distinct()
    cores = F.when(F.col("at") < 2008.5, "Processors").when(F.col("at") < 2011.5, "Cores").otherwise("Total Cores")
    heads = lists.select("at", F.lit(0).alias("line"), F.concat_ws(",", F.lit(LIST_HEADER), cores, F.lit("RMax"), F.lit("RPeak")).alias("value"))
    titles = lists.filter("at < 2008").select("at", F.lit(-1).alias("line"), F.concat(F.lit("List of "), F.col("at").cast("string")).alias("value"))
    named = F.concat(F.floor("at").cast("string"), F.when(F.col("at") % 1 > 0, "_11").otherwise("_06"))
    whole = rows.unionByName(heads).unionByName(titles).withColumn("edition", named)
    path = fresh_path(spark, "lists")
    # an edition's lines are 502 at most and belong into one file in their order
    whole.repartition("edition").sortWithinPartitions("edition", "line").select("value", "edition").write.partitionBy("edition").text(path)
    return path


def q_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of two eras, with and without title lines, read back as files and cut to the editions from November 2006 on."""
    rows = read_lists(spark, write_lists(spark, sf_dir), first=2006.5)
    return rows.select(
        "rank_year", "edition", "listing", "rank", F.col("computer").cast("long").alias("o_orderkey"), "country", F.col("year").cast("long").alias("year"),
        "nmax", "processor", "segment", F.col("name").cast("long").alias("o_custkey"), "accel_name", "accel_present", "cores", "rmax", "rpeak",
    )


def q_era_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    edition = date_to_edition(F.col("l_shipdate"))
    return lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", era_value(edition, LINE_ERAS, "speed").alias("speed")
    )


def q_ratio_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rmax, rpeak = F.col("l_extendedprice"), F.col("rpeak")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("rpeak", repaired_rpeak(rmax, F.col("l_quantity") * 2000))
        .select(
            "l_orderkey",
            "l_partkey",
            "rpeak",
            efficiency_ratio(rmax, rpeak).alias("perf_ratio"),
            relative_gap(rmax, rpeak).alias("relative_gap"),
        )
    )


def q_edition_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_per_edition(
        editions(spark, sf_dir), ["edition"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], LISTED
    )
    return top.select("edition", F.col("rank").cast("long").alias("rank"), "o_orderkey", "o_totalprice")


def q_nth_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of place 500 of each edition and status, and of place 20 000, which smaller editions do not have."""
    found = [
        nth_values(editions(spark, sf_dir), ["edition", "o_orderstatus"], "o_totalprice", n, sorted_rows=1000).withColumn("place", F.lit(n).cast("long"))
        for n in (LISTED, 20_000)
    ]
    return union_all(found)


def q_edition_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("metric"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("listing"),
    )
    sellers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("metric"),
        F.lit("supplier").alias("listing"),
    )
    return union_all([buyers, sellers])


def q_spec_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    is_cpu = F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")
    cpus = parts.filter(is_cpu).select("p_partkey", F.col("p_name").alias("processor"), F.col("p_size").alias("tdp"))
    gpus = parts.filter(~is_cpu).select("p_partkey", F.col("p_name").alias("gpu_model"), F.col("p_size").alias("gpu_tdp"))
    return union_all([cpus.withColumn("type", F.lit("CPU")), gpus.withColumn("type", F.lit("GPU"))])


def q_spec_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"p_name": "processor", "p_brand": "manufacturer", "p_size": "tdp"}
    return table(spark, sf_dir, "part").withColumnsRenamed(names).drop("p_retailprice", "p_type")


def q_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return headers(lines.withColumn("l_returnflag", null_if(F.col("l_returnflag"), "N"))).select(
        F.col("position").cast("long").alias("position"), "column_name", "n_values"
    )


def q_regex_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_matching(table(spark, sf_dir, "lineitem"), "price|disc|orderkey")


def q_zone_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("ts", "dd/MM/yyyy HH:mm")
    )
    date = parse_reading_time(text)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("zone_key"),
        date.alias("reading_date"),
        F.year(date).cast("long").alias("year"),
        F.month(date).cast("long").alias("month"),
        F.col("value").alias("life_cycle"),
    )


def q_zone_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    zones = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("country"),
            F.when(F.col("s_acctbal") >= 1000, F.concat(F.lit("Z"), (F.col("s_suppkey") % 3).cast("string"))).alias(
                "zone_key"
            ),
            F.col("s_suppkey").alias("zone_order"),
        )
    )
    return zone_dimension(zones, "zone_order")


def q_long_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"l_returnflag": "category", "l_linestatus": "unit", "l_linenumber": "area_type"}
    kept = filter_long(table(spark, sf_dir, "lineitem").withColumnsRenamed(names), "R", "F", 1)
    return kept.groupBy(
        F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").cast("long").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


def q_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("year")
    )
    path = save_table(rows, fresh_path(spark, "sink"), partition_by=["year"])
    back = spark.read.schema(rows.schema).parquet(path)
    return back.withColumn("year", F.col("year").cast("long"))


def q_entity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("p_name"), F.col("p_brand"), null_if(F.col("p_type"), "PROMO"), F.col("p_size"), F.col("p_partkey") % 7]
    return table(spark, sf_dir, "part").select("p_partkey", entity_key(*parts).alias("entity_key"))


def q_country_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(
        "c_custkey", normal_country(F.concat(F.lit(" "), F.col("country"), F.lit(" ")), ALIASES).alias("country")
    )


def q_semester_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions(spark, sf_dir).select(
        "o_orderkey", "rank_year", label_to_edition(F.col("rank_year")).alias("edition")
    )


def q_decimal_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions(spark, sf_dir).select(
        "o_orderkey", "edition", edition_to_date(F.col("edition")).alias("edition_date")
    )


def q_null_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = null_if(F.col("l_returnflag"), "N", "A")
    discount = F.nullif(F.col("l_discount"), F.lit(0.05))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        unknown_if_missing(flag).alias("flag"),
        F.coalesce(discount, F.lit(0.0)).alias("discount"),
        discount.isNull().alias("was_missing"),
    )


def q_accel_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn(
        "accelerator_present", accel_flag(null_if(F.col("l_returnflag"), "N"))
    )
    return rows.groupBy("l_linestatus", "accelerator_present").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity")
    )


# ---- lifecycle -----------------------------------------------------------------------------------


def q_presence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = presence_history(editions(spark, sf_dir), "o_custkey", "edition")
    counted = F.transform(
        "appearances",
        lambda a: F.concat(a.getField("edition").cast("string"), F.lit("x"), a.getField("n").cast("string")),
    )
    return history.select(
        "o_custkey",
        F.array_join(F.transform("editions", lambda e: e.cast("string")), ",").alias("editions"),
        F.array_join(counted, ",").alias("appearances"),
        "n_appearances",
        "first_edition",
        "final_edition",
        (F.col("final_edition") - F.floor("first_edition")).alias("lifespan"),
    )


def q_list_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers listed per half-year, and those that came and went since the one before."""
    return list_turnover(presence_bits(editions(spark, sf_dir), "o_custkey", "edition"), SPAN[0], SPAN[1])


def q_exit_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = with_presence(editions(spark, sf_dir), "o_custkey", "edition")
    labelled = with_exit_reason(present, thresholds(spark, sf_dir), "o_totalprice", MAX_EDITION)
    return labelled.select(
        "o_orderkey",
        "o_custkey",
        "edition",
        F.size("editions").cast("long").alias("n_editions"),
        "final_edition",
        "threshold",
        "exit_reason",
    )


def q_exit_reason_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q_exit_reason`` with lists of 1996 to 1999 missing: the first list after a system's last one decides."""
    kept = editions(spark, sf_dir).filter("edition not between 1996 and 1999 or o_orderkey % 3 = 0")
    limits = thresholds(spark, sf_dir).filter("final_edition < 1995.5 or final_edition >= 1999")
    present = with_presence(kept, "o_custkey", "edition")
    labelled = with_exit_reason(present, limits, "o_totalprice", MAX_EDITION, as_of=True)
    return labelled.select("o_orderkey", "o_custkey", "edition", "final_edition", "threshold", "exit_reason")


def q_exit_reason_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q_exit_reason`` with every system of ten orders or more spread over pieces."""
    orders = editions(spark, sf_dir)
    present = with_presence(orders, "o_custkey", "edition", hot_keys(orders, "o_custkey", min_rows=9, piece_rows=2))
    labelled = with_exit_reason(present, thresholds(spark, sf_dir), "o_totalprice", MAX_EDITION)
    return labelled.select(
        "o_orderkey", "o_custkey", "edition", F.size("editions").cast("long").alias("n_editions"), "final_edition", "threshold", "exit_reason"
    )


def _gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.when(kind == "click", F.col("value")).alias("reading"),
        F.when(kind.isin("error", "purchase"), kind).alias("processor"),
    )


def q_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_non_null(_gappy_events(spark, sf_dir), "user_id", "event_id", ["reading", "processor"])


def q_group_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_fill(_gappy_events(spark, sf_dir), "user_id", "event_id", ["reading", "processor"])


def q_group_fill_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q_group_fill`` as a scan over pieces of the whole table, which is the way of a table with a hot key."""
    return scan_fill(_gappy_events(spark, sf_dir), "user_id", "event_id", ["reading", "processor"])


def q_minimal_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fleet(spark, sf_dir)
    view = minimal_view(rows, "entity_id", "row_seq", ["country", "cpu_tdp", "gpu_tdp", "intensity_a", "intensity_b"], "edition")
    wanted = select_matching(view, "entity_id|editions|_tdp|country|intensity")
    return wanted.withColumns(
        {
            "editions": F.array_join(F.transform("editions", lambda e: e.cast("string")), ","),
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("cpu_tdp", "gpu_tdp", "intensity_a", "intensity_b")},
        }
    )


# ---- chip specifications -------------------------------------------------------------------------


def _spec_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One specification per part name."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("spec_name")).agg(
        F.max("p_size").cast("double").alias("tdp"), F.count(F.lit(1)).alias("n_parts")
    )


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as systems whose processor is written in several ways."""
    name, key = F.col("p_name"), F.col("p_partkey")
    first, second = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    watts = F.concat(F.col("p_size").cast("string"), F.lit("W"))
    written = (
        F.when(key % 5 == 0, F.upper(name))
        .when(key % 5 == 1, F.concat(first, second, F.lit(" "), watts))
        .when(key % 5 == 2, F.concat_ws(" ", second, F.col("p_type"), first))
        .when(key % 5 == 3, F.concat_ws(" ", F.translate(name, "eo", "o"), watts))
        .otherwise(name)
    )
    return table(spark, sf_dir, "part").select("p_partkey", written.alias("processor"))


def q_casefold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    step = F.col("l_linenumber") % 3
    written = (
        F.when(step == 0, F.upper("p_name")).when(step == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    )
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_partkey", "l_suppkey", written.alias("processor"))
    )
    return join_specs(rows, settle(_spec_sheet(spark, sf_dir), "specs"), "processor", "spec_name")


def q_spec_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = settle(_spec_sheet(spark, sf_dir), "specs")
    joined = join_specs(_systems(spark, sf_dir), specs.select("spec_name", "tdp"), "processor", "spec_name")
    return fill_missing_tdp(joined, specs, "processor", "tdp", "spec_name", "tdp")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _systems(spark, sf_dir).select(F.col("processor").alias("name"))
    return fuzzy_candidates(names, _spec_sheet(spark, sf_dir))


def q_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_candidates(spark, sf_dir), 6, "score")


def q_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(best_match(_candidates(spark, sf_dir)), 6, "score")


def q_spec_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_estimates(_candidates(spark, sf_dir), _spec_sheet(spark, sf_dir), "tdp")


def q_estimate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estimate_sources(_candidates(spark, sf_dir), _spec_sheet(spark, sf_dir), "tdp")
    return found.select("name", "spec_name", "tdp", F.round("weight").cast("int").alias("weight"))


def _line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )


def q_unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = _line_parts(spark, sf_dir).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.floor("l_extendedprice").alias("cores"),
        F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_extendedprice") / 2)).alias("accel_cores"),
        ((size % 8) * 8).alias("cpu_num_cores"),
        F.nullif((size % 11).cast("double"), F.lit(0.0)).alias("cpu_tdp"),
        F.when(size % 3 != 0, size * 10).alias("n_shaders"),
        F.when(size % 3 != 0, size % 4).alias("n_sm"),
        F.when(F.col("l_returnflag") == "R", size.cast("double")).alias("gpu_tdp"),
    )
    return with_unit_counts(rows).select("l_orderkey", "l_partkey", "l_suppkey", "num_cpus", "num_gpus")


def q_power_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    tdp = F.col("p_size") * 10.0
    idle, full = tdp * BASE.alpha, tdp * F.col("l_quantity")
    low, mid, high = BASE.tau_levels
    return (
        _line_parts(spark, sf_dir)
        .groupBy("p_brand")
        .agg(
            F.round(F.sum(semester_gwh(low, idle, full)), 9).alias("low_gwh"),
            F.round(F.sum(semester_gwh(mid, idle, full)), 9).alias("mid_gwh"),
            F.round(F.sum(semester_gwh(high, idle, full)), 9).alias("high_gwh"),
        )
    )


def _line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per part name with some missing."""
    flag = F.col("l_returnflag")
    return _line_parts(spark, sf_dir).select(
        "p_name",
        F.when(flag != "A", F.col("p_size")).alias("cpu_tdp"),
        F.when(flag == "R", F.col("l_quantity")).alias("gpu_tdp"),
        (F.col("l_linenumber") % 4).alias("second_gpu_tdp"),
    )


def q_missing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_audit(_line_values(spark, sf_dir), "p_name", ["cpu_tdp", "gpu_tdp", "second_gpu_tdp"])


def q_missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_rate(_line_values(spark, sf_dir), ["cpu_tdp", "gpu_tdp", "second_gpu_tdp"])


# ---- electricity ---------------------------------------------------------------------------------


def q_provider_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intensity(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("year", "month")})


def q_intensity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        editions(spark, sf_dir)
        .join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.upper("country").alias("country"), month_start(F.col("o_orderdate")).alias("year_month"))
    )
    monthly = settle(intensity(spark, sf_dir), "intensity")
    return with_intensity(rows, monthly, "country", "year_month", ["intensity_a", "intensity_b"])


def q_yearly_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = ["intensity_b", "intensity_a", "intensity_a_direct"]
    # chosen before the first aggregate; a filter on the merged key of the outer join would not get there
    of_country = [provider(spark, sf_dir, COUNTRY, 1997) for provider in (provider_a, provider_b)]
    means = yearly_means(compare_providers(*of_country), COUNTRY, sources, 1997)
    return rounded(means, 6, *sources).withColumn("year", F.col("year").cast("long"))


# ---- impact --------------------------------------------------------------------------------------


def q_impact_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country's series from a stored fleet that is partitioned by country: only its partition is read."""
    rows = fleet(spark, sf_dir)
    final = presence_history(editions(spark, sf_dir), "o_custkey", "edition").select(F.col("o_custkey").alias("entity_id"), "final_edition")
    stored = save_table(rows.join(final, "entity_id"), fresh_path(spark, "fleet"), partition_by=["country"])
    series = plans.impact(spark.read.parquet(stored), thresholds(spark, sf_dir), COUNTRY_SLICE, MAX_EDITION)
    return rounded_impact(series)


def q_filter_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fleet(spark, sf_dir, with_carbon=False)
    kept = slice_fleet(rows, COUNTRY_SLICE)
    return kept.select("entity_id", "o_orderkey", "country", "segment", "edition", "metric")


def q_distinct_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_options(customers(spark, sf_dir), "country")


def _entities(spark: SparkSession, sf_dir: str, with_carbon: bool = True) -> DataFrame:
    return plans.entities(fleet(spark, sf_dir, with_carbon), thresholds(spark, sf_dir), BASE, MAX_EDITION)


def q_semester_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = expand_semesters(_entities(spark, sf_dir), BASE).filter("active")
    return rows.select("entity_id", "semester", *ENERGY, "total_carbon_t")


def q_energy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = plans.impact(fleet(spark, sf_dir, with_carbon=False), thresholds(spark, sf_dir), BASE, MAX_EDITION)
    return rounded_impact(series.select("semester", "year_month", *ENERGY, *TURNOVER))


def q_carbon_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = plans.impact(fleet(spark, sf_dir), thresholds(spark, sf_dir), BASE, MAX_EDITION)
    return rounded_impact(series)


def q_carbon_series_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = ImpactParams(span=SPAN, time_after_drop=2.0, provider="Ember", idle_scope="system", listing="F")
    series = plans.impact(fleet(spark, sf_dir), thresholds(spark, sf_dir), params, MAX_EDITION)
    return rounded_impact(series)


def q_carbon_by_semester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every semester at its own intensity."""
    monthly = settle(intensity(spark, sf_dir), "intensity")
    rows = fleet(spark, sf_dir, with_carbon=False)
    return rounded_impact(plans.impact_by_semester(rows, thresholds(spark, sf_dir), monthly, BASE, MAX_EDITION))


def q_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn(expand_semesters(_entities(spark, sf_dir, with_carbon=False), BASE), SPAN)


def q_fleet_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = plans.fleet_average(fleet(spark, sf_dir), thresholds(spark, sf_dir), COUNTRY_SLICE, MAX_EDITION)
    return rounded_impact(average)


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.entity_vs_fleet(fleet(spark, sf_dir), thresholds(spark, sf_dir), COUNTRY_SLICE, MAX_EDITION)


def q_entity_vs_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_impact(_comparison(spark, sf_dir))


def q_kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = plans.key_figures(_comparison(spark, sf_dir))
    return rounded(rounded_impact(figures), 6, "energy_ratio", "carbon_ratio")


def q_unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.comparison_long(rounded_impact(_comparison(spark, sf_dir)))


# Slices answered from one cube, by label.
CUBE_SLICES = {
    "all": BASE,
    "country": replace(BASE, country=COUNTRY),
    "filled": replace(BASE, segments=("MACHINERY",), listing="F"),
    "mixed": COUNTRY_SLICE,
    "mixed open": replace(BASE, segments=("BUILDING", "MACHINERY"), listing="O"),
}


def _cube(spark: SparkSession, sf_dir: str) -> cubes.ImpactCube:
    """The cube of a fleet in which one order in five stands under another segment, so systems cross segments and listings."""
    moved = F.when(F.col("o_orderkey") % 5 == 0, F.lit("MACHINERY")).otherwise(F.col("segment"))
    rows = fleet(spark, sf_dir).withColumn("segment", moved)
    return cubes.build_cube(rows, thresholds(spark, sf_dir), BASE, MAX_EDITION)


def q_impact_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    answers = [cubes.cube_impact(cube, params).withColumn("slice", F.lit(name)) for name, params in CUBE_SLICES.items()]
    return rounded_impact(union_all(answers))


def q_impact_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of every region's first nation in alphabetical order, as calls of a SQL table function."""
    cubes.register_functions(_cube(spark, sf_dir), "catalog")
    table(spark, sf_dir, "nation").createOrReplaceTempView("catalog_nation")
    return rounded_impact(
        spark.sql(
            "SELECT n.name, c.* FROM (SELECT min(n_name) AS name FROM catalog_nation GROUP BY n_regionkey) n, "
            "LATERAL catalog_comparison(country => n.name, segment => 'MACHINERY') c"
        )
    )


# ---- statistics ----------------------------------------------------------------------------------


def q_zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("price"),
    )
    return remove_outliers(lines, "price", 1.5)


def q_growth_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = (
        editions(spark, sf_dir)
        .groupBy(((F.col("edition") - SPAN[0]) * 2).cast("long").alias("step"))
        .agg(F.max("o_totalprice").alias("rmax"))
    )
    curves = growth_curves(series, "step", "rmax", start=2, a=2.0, b=0.25)
    return rounded(curves, 4, "doubling_4", "doubling_3", "exponential")


def q_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 10, seed=7)


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return preview_transposed(orders, "o_orderkey", 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("q_")}
