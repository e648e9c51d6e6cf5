"""Power, utilisation and unit-count formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Watts over one semester to GWh: hours in a mean month, six months, 1e9 W per GW.
HOURS_PER_MONTH = 24 * (365 / 12)


def zero_if_missing(value: Column) -> Column:
    """NULL and NaN count as zero inside the power formulas only."""
    number = value.cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def mean_watts(tau: float | Column, idle_watts: Column, full_watts: Column) -> Column:
    """Power drawn at utilisation ``tau``."""
    return idle_watts * (1 - tau) + full_watts * tau


def semester_gwh(tau: float | Column, idle_watts: Column, full_watts: Column) -> Column:
    """Energy of a semester at utilisation ``tau`` between idle and full power."""
    return mean_watts(tau, idle_watts, full_watts) * HOURS_PER_MONTH / 1e9 * 6


def age_class(age: Column, lifespan: Column) -> Column:
    """0 in the first semester, 1 in the second, 2 from one year until the lifespan ends, else NULL."""
    return (
        F.when(age == 0, 0)
        .when(age == 0.5, 1)
        .when((age >= 1) & (age < lifespan), 2)
    )


def utilisation(level: Column, tau_levels: tuple[float, float, float]) -> Column:
    """Utilisation of an age class, NULL when not running."""
    first, second, later = tau_levels
    return F.when(level == 0, first).when(level == 1, second).when(level == 2, later)


def extended_lifespan(lifespan: Column, reason: Column, time_after_drop: float) -> Column:
    """Systems pushed off the list keep running for a while; removed ones stop."""
    return F.when(reason == "Dropped", lifespan + time_after_drop).otherwise(lifespan)


def unit_count(cores: Column, cores_per_unit: Column, tdp: Column, multiplier: Column | None = None) -> Column:
    """Units from core counts; a system with a known TDP has at least one."""
    units = F.when(cores_per_unit > 0, F.try_divide(cores.cast("double"), cores_per_unit))
    if multiplier is not None:
        units = units * multiplier
    units = F.coalesce(units, F.lit(0.0))
    return F.when((tdp > 0) & (units == 0), 1.0).otherwise(units)


def efficiency_ratio(rmax: Column, rpeak: Column) -> Column:
    return F.try_divide(rmax, rpeak)


def repaired_rpeak(rmax: Column, rpeak: Column) -> Column:
    """A peak below the measured maximum has lost a factor of ten."""
    return F.when(efficiency_ratio(rmax, rpeak) > 1, rpeak * 10).otherwise(rpeak)


def relative_gap(rmax: Column, rpeak: Column) -> Column:
    return F.try_divide(rpeak - rmax, rpeak)


def accel_flag(accel_name: Column) -> Column:
    return F.when(accel_name.isNotNull(), "Yes").otherwise("No")
