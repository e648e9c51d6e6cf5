"""Parameterised impact queries over a fleet table (one row per system, edition and listing).

Expected columns: entity_id, row_seq, edition, installation_year, country, segment, listing, metric,
cpu_tdp, gpu_tdp, num_cpus, num_gpus, intensity_a, intensity_b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.operators.expansion import impact_series
from fleetfootprint.operators.fill import first_known, first_value
from fleetfootprint.operators.intensity import with_intensity
from fleetfootprint.operators.lifecycle import exit_label
from fleetfootprint.operators.reshape import metrics_to_long, union_all
from fleetfootprint.operators.slicing import slice_condition
from fleetfootprint.schemas import MAX_EDITION, ImpactParams
from fleetfootprint.session import settle

CARRIED = ("cpu_tdp", "gpu_tdp", "num_cpus", "num_gpus")
ENERGY_AND_CARBON = ("cpu_gwh", "gpu_gwh", "total_gwh", "cpu_carbon_t", "gpu_carbon_t", "total_carbon_t")


def systems_by_scope(
    fleet: DataFrame, scopes: dict[str, Column], intensity: str, countries: bool = False, more: tuple[str, ...] = ()
) -> DataFrame:
    """One row per system: final edition and, per scope, the first known value of each input within the scope.

    Lifespans come from all rows of a system, the other values from its rows inside the scope. All scopes share one
    scan and one shuffle, and the aggregate combines before it. ``countries`` adds the countries a system was listed in.
    """
    order = F.col("row_seq")
    # a fleet as built knows every system's final edition, so it is right on any of its rows
    final = "final_edition" if "final_edition" in fleet.columns else "edition"
    aggregates = [F.max(final).alias("final_edition")]
    if countries:
        aggregates += [F.collect_set("country").alias("countries"), F.bool_or(F.col("country").isNull()).alias("no_country")]
    for name, inside in scopes.items():
        aggregates.append(F.min(F.when(inside, order)).alias(f"{name}__seen"))
        aggregates.append(first_value(F.col("metric"), order, inside).alias(f"{name}__metric"))
        for c in ("installation_year", *CARRIED, intensity, *more):
            aggregates.append(first_known(F.col(c), order, inside).alias(f"{name}__{c}"))
    return fleet.groupBy("entity_id").agg(*aggregates)


def with_lifecycle(
    systems: DataFrame,
    thresholds: DataFrame,
    scopes: dict[str, Column],
    intensity: str,
    max_edition: float = MAX_EDITION,
    more: tuple[str, ...] = (),
) -> DataFrame:
    """One row per scope and system of that scope, with lifespan and exit reason, from ``systems_by_scope``."""
    columns = ("seen", "metric", "installation_year", *CARRIED, intensity, *more)
    per_scope = [
        F.struct(F.lit(name).alias("scope"), *[F.col(f"{name}__{c}").alias(c) for c in columns]) for name in scopes
    ]
    per_system = (
        systems.filter(F.col("final_edition") < max_edition)
        .select("entity_id", "final_edition", F.inline(F.array(*per_scope)))
        .filter(F.col("seen").isNotNull())
    )
    return (
        per_system.join(thresholds, "final_edition", "left")
        .withColumns(
            {
                "lifespan": F.col("final_edition") - F.col("installation_year"),
                "exit_reason": exit_label(F.col("metric"), F.col("threshold")),
            }
        )
        .drop("seen", "metric", "threshold")
    )


def sliced(fleet: DataFrame, params: ImpactParams) -> DataFrame:
    """Rows of ``fleet`` that the slice's systems need.

    Where the fleet carries the final edition of each system (as built), the slice itself reaches the scan and
    prunes partitions. A bare edition table needs all rows of the slice's systems: a semi-join on their ids.
    """
    if params.country is None and params.segments is None and params.listing is None:
        return fleet
    inside = fleet.filter(slice_condition(params))
    if "final_edition" in fleet.columns:
        return inside
    # rows without an id are one system, as in the aggregate
    systems = inside.select(F.col("entity_id").alias("_inside")).distinct()
    return fleet.join(systems, F.col("entity_id").eqNullSafe(F.col("_inside")), "left_semi")


def entities(fleet: DataFrame, thresholds: DataFrame, params: ImpactParams, max_edition: float = MAX_EDITION) -> DataFrame:
    """Systems of one slice."""
    scope = {"slice": slice_condition(params)}
    systems = systems_by_scope(sliced(fleet, params), scope, params.intensity_column)
    return with_lifecycle(systems, thresholds, scope, params.intensity_column, max_edition).drop("scope")


def impact(fleet: DataFrame, thresholds: DataFrame, params: ImpactParams, max_edition: float = MAX_EDITION) -> DataFrame:
    """Energy, carbon and turnover of a slice per semester; no rows when the slice is empty."""
    return impact_series(entities(fleet, thresholds, params, max_edition), params)


def impact_by_semester(
    fleet: DataFrame, thresholds: DataFrame, monthly: DataFrame, params: ImpactParams, max_edition: float = MAX_EDITION
) -> DataFrame:
    """``impact`` with each semester's own intensity (``monthly``) in place of one per system for its whole life.

    Energy is linear in the systems of a country, so the intensity joins a row per country and semester.
    """
    scope, column = {"slice": slice_condition(params)}, params.intensity_column
    systems = systems_by_scope(sliced(fleet, params), scope, column, more=("country",))
    systems = with_lifecycle(systems, thresholds, scope, column, max_edition, ("country",))
    per_country = with_intensity(impact_series(systems, params, by=["country"]), monthly, "country", "year_month", [column])
    value = F.coalesce(column, F.lit(0.0))
    energy, counts = ("cpu_gwh", "gpu_gwh", "total_gwh"), ("systems_added", "systems_removed", "active_systems", "total_systems")
    return per_country.groupBy("semester", "year_month").agg(
        *[F.sum(c).alias(c) for c in energy],
        *[F.sum(F.col(c) * value).alias(c.replace("_gwh", "_carbon_t")) for c in energy],
        *[F.sum(c).alias(c) for c in counts],
    )


def _one_pass(
    fleet: DataFrame, thresholds: DataFrame, params: ImpactParams, scopes: dict[str, Column], max_edition: float
) -> tuple[DataFrame, Column]:
    """Series by scope and the number of distinct countries of the unfiltered table (a missing one counts as one).

    Both come from the rows per system, which are written once: the fleet is read a single time.
    """
    systems = settle(systems_by_scope(fleet, scopes, params.intensity_column, countries=True), "systems")
    named = systems.select(F.explode("countries").alias("country")).distinct().agg(F.count(F.lit(1))).scalar()
    unnamed = systems.agg(F.coalesce(F.bool_or("no_country").cast("int"), F.lit(0))).scalar()
    series = impact_series(with_lifecycle(systems, thresholds, scopes, params.intensity_column, max_edition), params, by=["scope"])
    return series, named + unnamed


def fleet_average(
    fleet: DataFrame, thresholds: DataFrame, params: ImpactParams, max_edition: float = MAX_EDITION
) -> DataFrame:
    """Series of all countries divided by the number of distinct countries of the unfiltered table."""
    scopes = {"fleet": slice_condition(params, with_country=False)}
    series, n = _one_pass(fleet, thresholds, params, scopes, max_edition)
    return series.select("semester", "year_month", *[(F.col(c) / n).alias(c) for c in ENERGY_AND_CARBON])


def entity_vs_fleet(
    fleet: DataFrame, thresholds: DataFrame, params: ImpactParams, max_edition: float = MAX_EDITION
) -> DataFrame:
    """A country's series next to the fleet average, by semester; both come from one pass over the fleet."""
    scopes = {
        "entity": slice_condition(params),
        "fleet": slice_condition(params, with_country=False),
    }
    series, n = _one_pass(fleet, thresholds, params, scopes, max_edition)
    mine = F.col("scope") == "entity"
    paired = series.groupBy("semester", "year_month").agg(
        *[F.max(F.when(mine, F.col(c))).alias(c) for c in ENERGY_AND_CARBON],
        *[
            F.max(F.when(mine, F.col(c))).alias(c)
            for c in ("systems_added", "systems_removed", "active_systems", "total_systems")
        ],
        *[(F.max(F.when(~mine, F.col(c))) / n).alias(f"fleet_{c}") for c in ENERGY_AND_CARBON],
    )
    return paired.filter(F.col("total_systems").isNotNull())


def key_figures(comparison: DataFrame) -> DataFrame:
    """Totals of the entity and of the fleet average over the entity's running years, and their ratios."""
    # a row per semester of the span, so one window sees them all; the comparison is worked out once
    running = F.when(F.col("total_gwh") > 0, F.col("year_month"))
    every = Window.partitionBy(F.lit(0))
    bounded = comparison.withColumns({"_first": F.min(running).over(every), "_last": F.max(running).over(every)})
    in_range = F.col("year_month").between(F.col("_first"), F.col("_last"))
    totals = bounded.filter(in_range).agg(
        F.min("year_month").alias("first_month"),
        F.max("year_month").alias("last_month"),
        (F.year(F.max("year_month")) - F.year(F.min("year_month")) + 1).cast("long").alias("n_years"),
        F.max("total_systems").alias("n_systems"),
        F.sum("total_gwh").alias("energy_gwh"),
        F.sum("total_carbon_t").alias("carbon_t"),
        F.sum("fleet_total_gwh").alias("fleet_energy_gwh"),
        F.sum("fleet_total_carbon_t").alias("fleet_carbon_t"),
    )
    return totals.withColumns(
        {
            "energy_ratio": F.try_divide("energy_gwh", "fleet_energy_gwh"),
            "carbon_ratio": F.try_divide("carbon_t", "fleet_carbon_t"),
        }
    )


def comparison_long(comparison: DataFrame) -> DataFrame:
    """Both series under one another, with a source label, one row per metric."""
    own = comparison.select("year_month", F.lit("entity").alias("source"), *ENERGY_AND_CARBON)
    average = comparison.select(
        "year_month", F.lit("fleet_average").alias("source"), *[F.col(f"fleet_{c}").alias(c) for c in ENERGY_AND_CARBON]
    )
    return metrics_to_long(union_all([own, average]), ["year_month", "source"], list(ENERGY_AND_CARBON))
