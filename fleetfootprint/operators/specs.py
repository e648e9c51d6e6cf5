"""Chip specifications: joins by name, fills for what did not match, unit counts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfootprint.functions.power import unit_count
from fleetfootprint.functions.text import folded
from fleetfootprint.operators.fuzzy import fuzzy_candidates, weighted_estimates
from fleetfootprint.schemas import DEFAULT_TDP
from fleetfootprint.session import settle


def join_specs(rows: DataFrame, specs: DataFrame, name: str, spec_name: str) -> DataFrame:
    """Left equi-join on case-folded names; spec names are unique, so rows are not multiplied."""
    keyed = specs.withColumn("_folded", folded(F.col(spec_name))).drop(spec_name)
    return rows.join(keyed, folded(F.col(name)) == F.col("_folded"), "left").drop("_folded")


def fill_missing_tdp(
    rows: DataFrame,
    specs: DataFrame,
    name: str,
    tdp: str,
    spec_name: str,
    spec_tdp: str,
    present: Column | None = None,
    default: float = DEFAULT_TDP,
) -> DataFrame:
    """Keep known values (above 0), estimate the rest from similar names, else use ``default`` where the
    part is ``present`` (by default: where it has a name). Each distinct name is scored once.
    """
    present = F.col(name).isNotNull() if present is None else present
    known = F.when(F.col(tdp) > 0, F.col(tdp))
    unmatched = rows.filter(known.isNull()).select(F.col(name).alias("name"))
    listed = specs.select(F.col(spec_name).alias("spec_name"), F.col(spec_tdp).alias("_spec_tdp"))
    candidates = fuzzy_candidates(unmatched, listed)
    estimates = settle(
        weighted_estimates(candidates, listed, "_spec_tdp", default=default).select("name", "estimate"), "estimates"
    )
    filled = F.coalesce(known, F.col("estimate"), F.when(present, F.lit(float(default))))
    keyed = estimates.withColumnRenamed("name", "_name")
    return (
        rows.join(keyed, (F.col(name) == F.col("_name")) & known.isNull(), "left")
        .withColumn(tdp, filled)
        .drop("_name", "estimate")
    )


def with_unit_counts(rows: DataFrame) -> DataFrame:
    """Number of CPUs and GPUs of each system."""
    accel_cores = F.coalesce("accel_cores", F.lit(0))
    return rows.withColumns(
        {
            "num_cpus": unit_count(F.col("cores") - accel_cores, F.col("cpu_num_cores"), F.col("cpu_tdp")),
            "num_gpus": unit_count(accel_cores, F.col("n_shaders"), F.col("gpu_tdp"), F.col("n_sm")),
        }
    )


def missing_audit(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Per name, how many rows lack each value (missing or 0); names that lack nothing are left out."""
    counts = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull() | (F.col(c) == 0)).alias(f"{c}_missing") for c in columns],
    )
    return counts.filter(F.greatest(*[F.col(f"{c}_missing") for c in columns]) > 0)


def missing_rate(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that lack each value, and the row count, in one row."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg((F.col(c).isNull() | (F.col(c) == 0)).cast("int")).alias(f"{c}_missing_rate") for c in columns],
    )
