"""A stored cube of impact series: slices are answered from its rows, the fleet is not read again.

A slice names one country or takes all, one listing or takes all, and any set of segments or all. The cube holds the
finished series of every choice with one segment or all. A set of segments adds up the changes of the systems that keep to one
segment; a system listed in several takes its inputs from its first rows inside the set, so such systems are kept as rows
and are worked out per slice (the correction). Everything but the slice is fixed when the cube is built.

Expected columns of the fleet are those of ``plans.impact``; others are ignored. Rows without a country, segment or listing
belong to no slice that names one. Rows without a ``row_seq`` give a system's final edition only. Of rows of a system that share a
``row_seq`` any may come first. An empty fleet gives an empty cube, an empty slice no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetfootprint.operators.expansion import impact_changes, series_of_changes, sum_changes
from fleetfootprint.operators.fill import first_known, first_value
from fleetfootprint.operators.lifecycle import exit_label
from fleetfootprint.operators.slicing import count_countries
from fleetfootprint.plans.impact import CARRIED, ENERGY_AND_CARBON
from fleetfootprint.schemas import MAX_EDITION, ImpactParams
from fleetfootprint.session import settle
from fleetfootprint.sources.sinks import save_table

SCOPE = ["country", "listing"]
TURNOVER = ("systems_added", "systems_removed", "active_systems", "total_systems")
PARTS = ("series", "changes", "crossing", "countries")


@dataclass(frozen=True)
class ImpactCube:
    """In all tables a missing country or listing stands for all of them; a missing segment in ``series`` as well."""

    series: DataFrame  # country, listing, segment, and a series each
    changes: DataFrame  # country, listing, segment, step: systems with one segment in the scope
    crossing: DataFrame  # country, listing, segment, entity_id: first known inputs of systems with several
    countries: DataFrame  # n_countries of the fleet
    params: ImpactParams


def _unsliced(params: ImpactParams) -> ImpactParams:
    return replace(params, country=None, segments=None, listing=None)


def _values(params: ImpactParams) -> tuple[str, ...]:
    return ("installation_year", *CARRIED, params.intensity_column)


def _first_of_cells(cells: DataFrame, by: list[str], params: ImpactParams) -> DataFrame:
    """One row per ``by`` and system: what comes first in any of its cells, with its place."""
    values = _values(params)
    return cells.groupBy(*by, "entity_id").agg(
        F.max("final_edition").alias("final_edition"),
        F.max("threshold").alias("threshold"),
        F.min_by("metric", "seen").alias("metric"),
        F.min("seen").alias("seen"),
        *[F.min_by(c, f"at_{c}").alias(c) for c in values],
        *[F.min(f"at_{c}").alias(f"at_{c}") for c in values],
    )


def _with_life(systems: DataFrame) -> DataFrame:
    return systems.withColumns(
        {
            "lifespan": F.col("final_edition") - F.col("installation_year"),
            "exit_reason": exit_label(F.col("metric"), F.col("threshold")),
        }
    )


def _scopes() -> Column:
    """The scopes of a cell: its country or all, its listing or all; what is missing is no scope of its own."""
    scopes = []
    for chosen in product((True, False), repeat=len(SCOPE)):
        known = F.lit(True)
        for c, named in zip(SCOPE, chosen):
            known = known & F.col(c).isNotNull() if named else known
        values = [(F.col(c) if named else F.lit(None).cast("string")).alias(c) for c, named in zip(SCOPE, chosen)]
        scopes.append(F.when(known, F.struct(*values)))
    return F.filter(F.array(*scopes), lambda s: s.isNotNull())


def build_cube(fleet: DataFrame, thresholds: DataFrame, params: ImpactParams, max_edition: float = MAX_EDITION) -> ImpactCube:
    """One scan of the fleet; the slice in ``params`` is ignored.

    Rows become one per system, country, segment and listing, combined before the shuffle; only these meet the four scopes.
    """
    params = _unsliced(params)
    values, order = _values(params), F.col("row_seq")
    final = "final_edition" if "final_edition" in fleet.columns else "edition"
    cells = fleet.groupBy("entity_id", "country", "segment", "listing").agg(
        F.max(final).alias("final_edition"),
        F.min(order).alias("seen"),
        first_value(F.col("metric"), order).alias("metric"),
        *[first_known(F.col(c), order).alias(c) for c in values],
        *[F.min(F.when(F.col(c).isNotNull(), order)).alias(f"at_{c}") for c in values],
    )
    # a system has at most as many cells as there are combinations of the three
    every = Window.partitionBy("entity_id")
    cells = settle(cells.withColumn("final_edition", F.max("final_edition").over(every)), "cells")
    countries = settle(count_countries(cells).select(F.coalesce("n_countries", F.lit(0)).cast("long").alias("n_countries")), "countries")

    gone = cells.filter((F.col("final_edition") < max_edition) & F.col("seen").isNotNull())
    gone = gone.join(thresholds.select("final_edition", "threshold"), "final_edition", "left")
    kept = [c for c in gone.columns if c not in SCOPE]
    scoped = gone.select(*kept, F.inline(_scopes()))
    # a segment's systems are its series alone; those with no other segment also add up with other segments' systems
    several = F.count(F.lit(1)).over(Window.partitionBy(*SCOPE, "entity_id")) > 1
    by_segment = _first_of_cells(scoped.filter(F.col("segment").isNotNull()), [*SCOPE, "segment"], params)
    by_segment = settle(by_segment.withColumn("several", several), "segments")
    parts = settle(impact_changes(_with_life(by_segment), params, [*SCOPE, "segment", "several"]), "changes")
    together = impact_changes(_with_life(_first_of_cells(scoped, SCOPE, params)), params, SCOPE)
    each = sum_changes(parts, [*SCOPE, "segment"]).unionByName(together.withColumn("segment", F.lit(None).cast("string")))
    return ImpactCube(
        series=settle(series_of_changes(each, params, [*SCOPE, "segment"]), "series"),
        changes=parts.filter(~F.col("several")).drop("several"),
        crossing=by_segment.filter("several").drop("several"),
        countries=countries,
        params=params,
    )


def save_cube(cube: ImpactCube, folder: str) -> None:
    """Write the cube's tables below ``folder``; the parameters are the caller's to keep."""
    for name in PARTS:
        save_table(getattr(cube, name), f"{folder}/{name}")


def load_cube(spark: SparkSession, folder: str, params: ImpactParams) -> ImpactCube:
    """A saved cube; ``params`` must be those it was built with."""
    return ImpactCube(**{name: spark.read.parquet(f"{folder}/{name}") for name in PARTS}, params=_unsliced(params))


def _in_scope(params: ImpactParams) -> Column:
    inside = F.lit(True)
    for c in SCOPE:
        value = getattr(params, c)
        inside = inside & (F.col(c).isNull() if value is None else F.col(c) == value)
    return inside


def cube_impact(cube: ImpactCube, params: ImpactParams) -> DataFrame:
    """``plans.impact.impact`` of a slice. ValueError if anything but the slice differs from the cube's parameters."""
    if _unsliced(params) != cube.params:
        raise ValueError(f"the cube was built for {cube.params}")
    chosen = None if params.segments is None else sorted(set(params.segments))
    if chosen is None or len(chosen) == 1:
        segment = F.col("segment").isNull() if chosen is None else F.col("segment") == chosen[0]
        return cube.series.filter(_in_scope(params) & segment).drop(*SCOPE, "segment")
    inside = _in_scope(params) & F.col("segment").isin(chosen)
    crossing = _with_life(_first_of_cells(cube.crossing.filter(inside), [], params))
    changes = cube.changes.filter(inside).drop(*SCOPE, "segment").unionByName(impact_changes(crossing, params))
    return series_of_changes(sum_changes(changes), params)


def cube_comparison(cube: ImpactCube, params: ImpactParams) -> DataFrame:
    """``plans.impact.entity_vs_fleet`` of a slice."""
    own, every = cube_impact(cube, params), cube_impact(cube, replace(params, country=None))
    n = cube.countries.scalar()
    average = every.select("semester", *[(F.col(c) / n).alias(f"fleet_{c}") for c in ENERGY_AND_CARBON])
    return own.join(average, "semester").select(
        "semester", "year_month", *ENERGY_AND_CARBON, *TURNOVER, *[f"fleet_{c}" for c in ENERGY_AND_CARBON]
    )


_RESULT = ", ".join(
    ["semester DOUBLE", "year_month DATE", *[f"{c} DOUBLE" for c in ENERGY_AND_CARBON], *[f"{c} BIGINT" for c in TURNOVER]]
)
_FLEET = ", ".join(f"fleet_{c} DOUBLE" for c in ENERGY_AND_CARBON)


def register_functions(cube: ImpactCube, name: str = "fleet") -> None:
    """SQL table functions ``<name>_impact`` and ``<name>_comparison`` of the cube's session.

    Both take (country, segment, listing), by place or by name; what is left out or NULL means all::

        SELECT * FROM fleet_impact(country => 'France', segment => 'Research')

    They read the temporary views ``<name>_series`` and ``<name>_comparisons``, and replace functions and views of these names.
    """
    spark = cube.series.sparkSession
    cube.series.createOrReplaceTempView(f"{name}_series")
    own, every = cube.series.alias("own"), cube.series.filter(F.col("country").isNull()).alias("every")
    n = cube.countries.scalar()
    same = F.col("own.semester") == F.col("every.semester")
    for c in ("listing", "segment"):
        same = same & F.col(f"own.{c}").eqNullSafe(F.col(f"every.{c}"))
    compared = own.join(every, same).select("own.*", *[(F.col(f"every.{c}") / n).alias(f"fleet_{c}") for c in ENERGY_AND_CARBON])
    compared.createOrReplaceTempView(f"{name}_comparisons")
    for function, view, columns in (
        (f"{name}_impact", f"{name}_series", _RESULT),
        (f"{name}_comparison", f"{name}_comparisons", f"{_RESULT}, {_FLEET}"),
    ):
        given = " AND ".join(f"s.{c} <=> {function}.{c}" for c in ("country", "segment", "listing"))
        listed = ", ".join(f"s.{c.split()[0]}" for c in columns.split(", "))
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {function}"
            "(country STRING DEFAULT NULL, segment STRING DEFAULT NULL, listing STRING DEFAULT NULL) "
            f"RETURNS TABLE({columns}) RETURN SELECT {listed} FROM {view} s WHERE {given}"
        )
