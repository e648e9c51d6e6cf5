"""Growth curves: a metric that doubles at a fixed pace, and a plain exponential."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubling_curve(baseline: Column, x: Column, period: float, start: float = 0.0) -> Column:
    return baseline * F.pow(F.lit(2.0), (x - start) / period)


def exponential_curve(x: Column, a: float, b: float) -> Column:
    return F.lit(a) * F.pow(F.exp(x), F.lit(b))
