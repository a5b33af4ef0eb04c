"""The price and time grid: bucket numbers, labels, ticks, candidate variance rates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsmill.functions.normal import density, probit

# Edges of the price buckets, of the bands of days to resolution, of the distances to the nearer boundary.
PRICE_EDGES = (0.0, 0.05, 0.15, 0.30, 0.45, 0.55, 0.70, 0.85, 0.95, 1.0)
TAU_EDGES = (1.0, 3.0, 7.0, 14.0, 30.0, 90.0)
DISTANCE_EDGES = (0.0, 0.05, 0.15, 0.30, 0.45, 0.501)
PRICE_CLIP = (0.005, 0.995)


def steps(x: Column, edges) -> Column:
    """Number of edges at or below x: stays in codegen, unlike an array search."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def price_bucket(p: Column) -> Column:
    return steps(p, PRICE_EDGES[1:-1])


def tau_band(tau: Column) -> Column:
    return steps(tau, TAU_EDGES[1:])


def distance_bucket(p: Column) -> Column:
    return steps(F.least(p, 1 - p), DISTANCE_EDGES[1:-1])


def _named(k: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


def price_label(bucket: Column) -> Column:
    return _named(bucket, [f"[{a:.2f},{b:.2f})" for a, b in zip(PRICE_EDGES, PRICE_EDGES[1:], strict=False)])


def tau_label(band: Column) -> Column:
    return _named(band, [f"[{a:g},{b:g})d" for a, b in zip(TAU_EDGES, (*TAU_EDGES[1:], float("inf")), strict=True)])


def folded_ticks(p: Column, dp: Column, unit: float) -> Column:
    """Whole ticks of a move, positive away from the nearer boundary; halves round to even."""
    return F.bround(F.when(p <= 0.5, dp).otherwise(-dp) / unit).cast("long")


def rates(p: Column, dt: Column, tau: Column) -> dict[str, Column]:
    """Variance that three candidate local rates expect of a move."""
    return {"v_binom": p * (1 - p) / tau * dt, "v_gauss": F.pow(density(probit(p)), 2) / tau * dt, "v_wf": p * (1 - p) * dt}


#: Edges 0.05, 0.10, ... 0.95 at which empirical rates are binned.
RATE_EDGES = tuple(i / 20 for i in range(1, 20))
