"""Rounding, clamping and piecewise-constant curves as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = tuple[tuple[float, float], ...]


def half_up(value: Column, scale: float = 1) -> Column:
    """``value`` in steps of 1 / scale, halves upwards."""
    return F.floor(value * F.lit(float(scale)) + 0.5) / F.lit(float(scale))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def ascending(value: Column, table: Curve, beyond: float) -> Column:
    """The entry of the first bound that ``value`` doesn't exceed; bounds count."""
    return reduce(lambda rest, step: F.when(value <= step[0], F.lit(step[1])).otherwise(rest), reversed(table), F.lit(beyond))


def descending(value: Column, table: Curve, beyond: float) -> Column:
    """The entry of the first bound that ``value`` reaches; bounds count."""
    return reduce(lambda rest, step: F.when(value >= step[0], F.lit(step[1])).otherwise(rest), reversed(table), F.lit(beyond))


def ascending_sql(value: str, table: Curve, beyond: float) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {a} THEN {b}::DOUBLE" for a, b in table) + f" ELSE {beyond}::DOUBLE END"


def descending_sql(value: str, table: Curve, beyond: float) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} THEN {b}::DOUBLE" for a, b in table) + f" ELSE {beyond}::DOUBLE END"
