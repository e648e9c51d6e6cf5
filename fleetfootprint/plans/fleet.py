"""From source tables to the fleet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.functions.calendar import edition_to_date
from fleetfootprint.functions.text import unknown_if_missing
from fleetfootprint.operators.fill import first_known, group_fill
from fleetfootprint.operators.intensity import compare_providers, with_intensity
from fleetfootprint.operators.lifecycle import rank_thresholds, with_exit_reason, with_presence
from fleetfootprint.operators.skew import hot_keys
from fleetfootprint.operators.specs import fill_missing_tdp, join_specs, with_unit_counts
from fleetfootprint.schemas import LIST_LENGTH, MAX_EDITION, PERFORMANCE_LISTING
from fleetfootprint.session import settle

INTENSITIES = ["intensity_a", "intensity_a_direct", "intensity_b"]


def computers(
    editions: DataFrame,
    metric: str = "rmax",
    max_edition: float = MAX_EDITION,
    hot: DataFrame | None = None,
    last_rank: int = LIST_LENGTH,
    keep_active: bool = False,
) -> DataFrame:
    """Editions with presence history, lifespan and exit reason.

    The threshold is the metric of place ``last_rank`` of the performance listing, the length the lists were read with.
    The editions are written once, for history, thresholds and result each read them.
    """
    return settled_computers(settle(editions, "editions"), metric, max_edition, hot, last_rank, keep_active)


def settled_computers(
    editions: DataFrame, metric: str, max_edition: float, hot: DataFrame | None, last_rank: int, keep_active: bool
) -> DataFrame:
    """``computers`` of editions that are cheap to read several times."""
    present = with_presence(editions, "entity_id", "edition", hot)
    limits = fleet_thresholds(editions, metric, last_rank)
    return with_exit_reason(present, limits, metric, max_edition, keep_active).withColumns(
        {
            "installation_year": F.col("year").cast("double"),
            "lifespan": F.col("final_edition") - F.col("year"),
            "segment": unknown_if_missing(F.col("segment")),
            "metric": F.col(metric),
        }
    )


def chips(
    systems: DataFrame, cpu_specs: DataFrame, gpu_specs: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Systems with chip specifications; names known in one listing are filled into the other first."""
    named = group_fill(systems, "entity_id", "row_seq", ["processor", "accel_name"], hot)
    cpu = cpu_specs.select(
        F.col("processor").alias("spec_processor"), F.col("tdp").alias("cpu_tdp"), F.col("num_cores").alias("cpu_num_cores")
    )
    gpu = gpu_specs.select("gpu_model", "gpu_tdp", "n_shaders", "n_sm", "second_gpu_tdp")
    joined = join_specs(named, cpu, "processor", "spec_processor")
    return join_specs(joined, gpu, "accel_name", "gpu_model")


def electricity(provider_a: DataFrame, provider_b: DataFrame) -> DataFrame:
    """Monthly intensity of both providers by country."""
    return compare_providers(provider_a, provider_b)


def build_fleet(
    editions: DataFrame,
    cpu_specs: DataFrame,
    gpu_specs: DataFrame,
    intensity: DataFrame,
    metric: str = "rmax",
    max_edition: float = MAX_EDITION,
    last_rank: int = LIST_LENGTH,
    keep_active: bool = False,
) -> DataFrame:
    """The full fleet table: one row per (system, edition, listing).

    The editions and the systems with chips are written once, because several later steps read a few of
    their columns each.
    """
    editions = settle(editions, "editions")
    hot = hot_keys(editions, "entity_id")
    systems = settled_computers(editions, metric, max_edition, hot, last_rank, keep_active)
    rows = settle(chips(systems, cpu_specs, gpu_specs, hot), "chips")
    rows = rows.withColumn("year_month", edition_to_date(F.col("edition")))
    rows = with_intensity(rows, settle(intensity, "intensity"), "country", "year_month", INTENSITIES)
    has_accel = F.col("accel_present") | F.col("accel_name").isNotNull()
    rows = fill_missing_tdp(rows, cpu_specs, "processor", "cpu_tdp", "processor", "tdp", F.lit(True))
    rows = fill_missing_tdp(rows, gpu_specs, "accel_name", "gpu_tdp", "gpu_model", "gpu_tdp", has_accel)
    return with_unit_counts(rows)


def fleet_thresholds(editions: DataFrame, metric: str = "rmax", last_rank: int = LIST_LENGTH) -> DataFrame:
    """Thresholds as used by the fleet table, for the impact queries."""
    ranked = editions.filter(F.col("listing") == PERFORMANCE_LISTING)
    return rank_thresholds(ranked, "rank", last_rank, "edition", metric)


def minimal_view(fleet: DataFrame, key: str, order: str, columns: list[str], edition: str) -> DataFrame:
    """One row per system: first known value of each column and its distinct editions in order."""
    return fleet.groupBy(key).agg(
        F.array_sort(F.collect_set(edition)).alias("editions"),
        *[first_known(F.col(c), F.col(order)).alias(c) for c in columns],
    )
