"""Systems over the semester grid: energy, carbon and turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfootprint.functions.calendar import edition_to_date
from fleetfootprint.functions.power import (
    age_class,
    extended_lifespan,
    mean_watts,
    semester_gwh,
    utilisation,
    zero_if_missing,
)
from fleetfootprint.schemas import ImpactParams

PARTS = ("cpu", "gpu")


def grid_size(span: tuple[float, float]) -> int:
    """Number of half-years in [lo, hi)."""
    return max(0, round((span[1] - span[0]) * 2))


def semester_grid(spark, span: tuple[float, float]) -> DataFrame:
    return spark.range(grid_size(span)).select((F.col("id") * 0.5 + span[0]).alias("semester"))


def with_power(entities: DataFrame, params: ImpactParams) -> DataFrame:
    """Idle and full power of each system, its running life, and the chosen intensity; unknowns become 0."""
    columns = {
        "install": zero_if_missing(F.col("installation_year")),
        "life": zero_if_missing(
            extended_lifespan(F.col("lifespan"), F.col("exit_reason"), params.time_after_drop)
        ),
        "intensity": zero_if_missing(F.col(params.intensity_column)),
    }
    for part in PARTS:
        tdp = zero_if_missing(F.col(f"{part}_tdp"))
        full = zero_if_missing(F.col(f"num_{part}s")) * tdp
        columns[f"{part}_full"] = full
        columns[f"{part}_idle"] = (full if params.idle_scope == "system" else tdp) * params.alpha
    return entities.withColumns(columns)


def _energy(part: str, tau: Column, suffix: str = "") -> Column:
    """Energy of a part at a utilisation, 0 when there is none."""
    return F.coalesce(semester_gwh(tau, F.col(f"{part}_idle{suffix}"), F.col(f"{part}_full{suffix}")), F.lit(0.0))


def _draws_power(tau: float | Column) -> Column:
    watts = [mean_watts(tau, F.col(f"{p}_idle"), F.col(f"{p}_full")) for p in PARTS]
    return F.coalesce(F.greatest(*watts) > 0, F.lit(False))


def _step_of(moment: Column, params: ImpactParams) -> Column:
    """Number of the first grid point at or after a moment."""
    return F.ceil((moment - params.span[0]) * 2).cast("int")


def expand_semesters(entities: DataFrame, params: ImpactParams) -> DataFrame:
    """One row per system and semester in which it runs.

    Only the running stretch of each system is generated, clipped to the span; ages 0 and 0.5 run
    whatever the lifespan. ``added``/``removed`` compare with the semester before, whose state follows
    from the same formula, so nothing is shuffled. The row after the last running semester is kept to
    carry the removal.
    """
    last = grid_size(params.span) - 1
    powered = with_power(entities, params)
    begin = F.greatest(_step_of(F.col("install"), params), F.lit(0))
    end = F.least(_step_of(F.col("install") + F.greatest(F.col("life"), F.lit(1.0)), params), F.lit(last))
    steps = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
    rows = powered.withColumn("_step", F.explode(steps))
    rows = rows.withColumn("semester", F.col("_step") * 0.5 + params.span[0])
    age = F.col("semester") - F.col("install")
    before = F.when(F.col("_step") > 0, age_class(age - 0.5, F.col("life")))
    rows = rows.withColumns(
        {
            "_tau": utilisation(age_class(age, F.col("life")), params.tau_levels),
            "_tau_before": utilisation(before, params.tau_levels),
        }
    ).withColumns(
        {f"{p}_gwh": _energy(p, F.col("_tau")) for p in PARTS}
        | {"active": _draws_power(F.col("_tau")), "_ran": _draws_power(F.col("_tau_before"))}
    )
    rows = rows.withColumn("total_gwh", F.col("cpu_gwh") + F.col("gpu_gwh")).withColumns(
        {f"{p}_carbon_t": F.col(f"{p}_gwh") * F.col("intensity") for p in (*PARTS, "total")}
        | {"added": F.col("active") & ~F.col("_ran"), "removed": F.col("_ran") & ~F.col("active")}
    )
    return rows.drop("_step", "_ran", "_tau", "_tau_before")


def _cohorts(entities: DataFrame, params: ImpactParams, by: list[str]) -> DataFrame:
    """Systems with the same installation and running life, summed up.

    Energy is linear in idle and full power, so sums per cohort are all the series needs; the number of
    cohorts depends on the years covered and not on the number of systems.
    """
    powered = with_power(entities, params)
    runs = [_draws_power(tau) for tau in params.tau_levels]
    sums = []
    for p in PARTS:
        for load in ("idle", "full"):
            watts = F.col(f"{p}_{load}")
            sums.append(F.sum(watts).alias(f"{p}_{load}"))
            sums.append(F.sum(watts * F.col("intensity")).alias(f"{p}_{load}_weighted"))
    counts = [F.count_if(r).alias(f"runs_{k}") for k, r in enumerate(runs)]
    steady = [F.count_if(runs[k] & runs[k + 1]).alias(f"runs_{k}{k + 1}") for k in range(2)]
    return powered.groupBy(*by, "install", "life").agg(F.count(F.lit(1)).alias("systems"), *sums, *counts, *steady)


# What an event adds: energy and carbon of its own semester, the same from there on, and systems.
_MOMENT = tuple(f"{p}{w}" for p in PARTS for w in ("", "_weighted"))
_COUNTS = ("active", "added", "removed", "systems", "steady_active", "steady_systems")


def _events(cohorts: DataFrame, params: ImpactParams, by: list[str]) -> DataFrame:
    """At most five rows per cohort, at the steps of the grid where something changes.

    A cohort starts, warms up, reaches the load that it keeps, and stops; one more row counts its systems. The first two
    semesters stand for themselves; what lasts is an amount at its first step and the same amount off after its last, to be added up over the
    grid. A cohort that runs when the span begins starts there. A cohort installed between two grid points has no first two semesters.
    """
    size = grid_size(params.span)
    at = (F.col("install") - params.span[0]) * 2
    on_grid, start = at == F.floor(at), F.floor(at)
    steady = F.ceil(at + 2)
    end = F.ceil((F.col("install") + F.col("life") - params.span[0]) * 2)
    begin = F.greatest(steady, F.lit(0))
    lasts = (end > steady) & (end > 0)
    # in the semester before, where there is one, the cohort was warming up
    warmed = on_grid & (steady > 0)

    def energies(level: int, sign: int = 1) -> dict[str, Column]:
        tau = F.lit(params.tau_levels[level])
        return {f"{p}{w}": _energy(p, tau, w) * sign for p in PARTS for w in ("", "_weighted")}

    def event(step: Column, when: Column, now: dict[str, Column] | None = None, kept: dict[str, Column] | None = None, **counts: Column) -> Column:
        fields = [step.cast("long").alias("step")]
        fields += [(now or {}).get(c, F.lit(0.0)).alias(c) for c in _MOMENT]
        fields += [(kept or {}).get(c, F.lit(0.0)).alias(f"steady_{c}") for c in _MOMENT]
        fields += [counts.get(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]
        return F.when(when & (step >= 0) & (step < size), F.struct(*fields))

    runs = [F.col(f"runs_{k}") for k in range(3)]
    second = start + 1
    events = [
        event(F.lit(0), F.lit(True), systems=F.col("systems")),
        event(start, on_grid, energies(0), active=runs[0], added=runs[0]),
        event(
            second, on_grid, energies(1), active=runs[1],
            added=runs[1] - F.when(second > 0, F.col("runs_01")).otherwise(0),
            removed=F.when(second > 0, runs[0] - F.col("runs_01")).otherwise(0),
        ),
        event(
            begin, lasts & (end > begin), None, energies(2), steady_active=runs[2], steady_systems=F.col("systems"),
            added=runs[2] - F.when(warmed, F.col("runs_12")).otherwise(0),
            removed=F.when(warmed, runs[1] - F.col("runs_12")).otherwise(0),
        ),
        # what lasted ends, or the second semester was the last
        F.when(
            lasts,
            event(end, end > begin, None, energies(2, -1), steady_active=-runs[2], steady_systems=-F.col("systems"), removed=runs[2]),
        ).otherwise(event(steady, warmed, removed=runs[1])),
    ]
    return cohorts.select(*by, F.inline(F.filter(F.array(*events), lambda x: x.isNotNull())))


# Columns of a table of changes, besides its groups and ``step``; changes of any systems may be added up.
CHANGES = (*_MOMENT, *(f"steady_{c}" for c in _MOMENT), *_COUNTS)


def impact_changes(entities: DataFrame, params: ImpactParams, by: list[str] | None = None) -> DataFrame:
    """What changes per step of the grid (and per ``by`` columns): ``by``, ``step`` and the sums ``CHANGES``."""
    by = by or []
    return sum_changes(_events(_cohorts(entities, params, by), params, by), by)


def sum_changes(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return changes.groupBy(*(by or []), "step").agg(*[F.sum(c).alias(c) for c in CHANGES])


def impact_series(entities: DataFrame, params: ImpactParams, by: list[str] | None = None) -> DataFrame:
    """Energy, carbon and turnover per semester (and per ``by`` columns) over the whole span.

    ``total_systems`` counts every system in every semester, running or not. Cohorts give their changes, which are added up
    per step and then along the grid, so the grid multiplies groups and never cohorts or systems.
    """
    return series_of_changes(impact_changes(entities, params, by), params, by)


def series_of_changes(per_step: DataFrame, params: ImpactParams, by: list[str] | None = None) -> DataFrame:
    """The series that changes (one row per ``by`` and step) add up to; no rows for groups without systems."""
    by = by or []
    size = grid_size(params.span)
    groups = per_step.groupBy(*by).agg(
        F.sum("systems").alias("total_systems"), F.map_from_entries(F.collect_list(F.struct("step", F.struct(*CHANGES)))).alias("_steps")
    )
    grid = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")) if size else F.array().cast("array<long>")
    rows = groups.filter(F.col("total_systems").isNotNull()).withColumn("_step", F.explode(grid))
    rows = rows.withColumn("_at", F.try_element_at("_steps", F.col("_step"))).withColumn("semester", F.col("_step") * 0.5 + params.span[0])
    so_far = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)

    def now(name: str) -> Column:
        return F.coalesce(F.col("_at")[name], F.lit(0))

    def lasting(name: str) -> Column:
        return F.sum(now(f"steady_{name}")).over(so_far)

    def amount(name: str) -> Column:
        # sums of amounts put on and taken off are exactly nothing only where no system is left
        return now(name) + F.when(lasting("systems") > 0, lasting(name)).otherwise(0.0)

    series = rows.select(
        *by,
        "semester",
        *[amount(p).alias(f"{p}_gwh") for p in PARTS],
        *[amount(f"{p}_weighted").alias(f"{p}_carbon_t") for p in PARTS],
        now("added").alias("systems_added"),
        now("removed").alias("systems_removed"),
        (now("active") + lasting("active")).alias("active_systems"),
        "total_systems",
    )
    return series.select(
        *by,
        "semester",
        edition_to_date(F.col("semester")).alias("year_month"),
        "cpu_gwh",
        "gpu_gwh",
        (F.col("cpu_gwh") + F.col("gpu_gwh")).alias("total_gwh"),
        "cpu_carbon_t",
        "gpu_carbon_t",
        (F.col("cpu_carbon_t") + F.col("gpu_carbon_t")).alias("total_carbon_t"),
        "systems_added",
        "systems_removed",
        "active_systems",
        "total_systems",
    )


def churn(expanded: DataFrame, span: tuple[float, float]) -> DataFrame:
    """Added, removed and active systems of every semester of the span, from expanded rows."""
    counts = expanded.groupBy("semester").agg(
        F.count_if("added").alias("systems_added"),
        F.count_if("removed").alias("systems_removed"),
        F.count_if("active").alias("active_systems"),
    )
    columns = ("systems_added", "systems_removed", "active_systems")
    grid = semester_grid(expanded.sparkSession, span)
    return grid.join(counts, "semester", "left").na.fill(0, list(columns))
