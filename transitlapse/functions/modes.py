"""Transport modes, service text and class lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five modes with their priority, and the route_type codes and ranges of each.
MODES = ["rail", "metro", "tram", "bus", "other"]
MODE_PRIORITY = {"rail": 5, "metro": 4, "tram": 3, "bus": 2, "other": 1}
ROUTE_TYPE_RANGES = [
    (0, 0, "tram"), (1, 1, "metro"), (2, 2, "rail"), (3, 3, "bus"), (11, 11, "bus"), (12, 12, "metro"),
    (100, 117, "rail"), (200, 209, "bus"), (300, 399, "rail"), (400, 405, "metro"), (700, 716, "bus"),
    (800, 802, "bus"), (900, 906, "tram"),
]
MODE_TO_ROUTE_TYPE = {"tram": "0", "metro": "1", "rail": "2", "bus": "3", "other": "3"}


def route_mode(route_type: Column) -> Column:
    expr = None
    for lo, hi, mode in ROUTE_TYPE_RANGES:
        cond = route_type.between(lo, hi)
        expr = F.when(cond, mode) if expr is None else expr.when(cond, mode)
    return expr.otherwise("other")


def mode_rank(mode: Column) -> Column:
    """0 for the most important mode."""
    return F.lit(5) - mode_priority(mode)


def mode_priority(mode: Column) -> Column:
    expr = None
    for m, p in MODE_PRIORITY.items():
        expr = F.when(mode == m, p) if expr is None else expr.when(mode == m, p)
    return expr.otherwise(1)


def mode_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MODES]), (rank + 1).cast("int"))


def primary_mode(modes: Column) -> Column:
    """Highest-priority mode of an array; an empty or null array is ``other``."""
    top = F.array_min(F.transform(modes, lambda m: mode_rank(m)))
    return F.coalesce(mode_of_rank(top), F.lit("other"))


def mode_flags(modes: Column) -> list[Column]:
    shown = F.when(F.size(F.coalesce(modes, F.array().cast("array<string>"))) > 0, modes).otherwise(
        F.array(F.lit("other")))
    return [F.array_contains(shown, m).alias(f"is_{m}") for m in MODES]


def minutes_of_day(text: Column) -> Column:
    """``H:MM:SS`` (hours may be unpadded or past 24) to minutes."""
    part = lambda i: F.split_part(text, F.lit(":"), F.lit(i)).try_cast("int")
    return part(1) * 60 + part(2)


def gtfs_date(text: Column) -> Column:
    """``YYYYMMDD`` to a date; anything else, impossible days included, is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd"))


def iso_date(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{8}$"),
                  F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))


def step_class(value: Column, breaks: list[float]) -> Column:
    """Number of breaks at or below ``value``."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in breaks), F.lit(0)).cast("int")


# Class breaks of the overlays.
FREQUENCY_BREAKS = [50.0, 150.0, 400.0, 800.0]
FREQUENCY_PERCENT_BREAKS = [-0.5, -0.15, 0.15, 0.5]
FREQUENCY_DELTA_BREAKS = [-50.0, -10.0, 10.0, 50.0]
POPULATION_BREAKS = [0.2, 0.4, 0.6, 0.8]
POPULATION_DELTA_BREAKS = [-25.0, -10.0, 10.0, 25.0]


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.when(value < lo, F.lit(lo)).when(value > hi, F.lit(hi)).otherwise(value)
