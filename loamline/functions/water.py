"""Soil-water column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.schemas import DEFAULT_WEIGHTS


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weight_fraction(layers: Mapping[int, Column], weights: Mapping[int, float] = DEFAULT_WEIGHTS) -> Column:
    """Sum of the weights of the depths that have a value; depths without a weight are ignored."""
    total = F.lit(0.0)
    for depth, theta in layers.items():
        if depth in weights:
            total = total + F.when(theta.isNotNull(), F.lit(weights[depth])).otherwise(F.lit(0.0))
    return total


def root_zone_theta(
    layers: Mapping[int, Column], fraction: Column, weights: Mapping[int, float] = DEFAULT_WEIGHTS
) -> Column:
    """Weighted mean moisture over usable depths, summed in depth order; null when none is usable."""
    total = F.lit(0.0)
    for depth, theta in layers.items():
        if depth in weights:
            total = total + F.coalesce((F.lit(weights[depth]) / F.nullif(fraction, F.lit(0.0))) * theta, F.lit(0.0))
    return F.when(fraction > 0, total)


def depletion(theta: Column, fc: Column, wp: Column) -> Column:
    return (fc - theta) / (fc - wp)


def available_water(dr: Column) -> Column:
    return F.lit(1.0) - dr


def storage_mm(theta: Column, root_depth_cm: Column) -> Column:
    return F.lit(10.0) * root_depth_cm * theta


def deficit_mm(theta: Column, fc: Column, root_depth_cm: Column) -> Column:
    return F.lit(10.0) * root_depth_cm * F.greatest(F.lit(0.0), fc - theta)


def total_available_water_mm(fc: Column, wp: Column, root_depth_cm: Column) -> Column:
    return F.lit(10.0) * root_depth_cm * (fc - wp)


def theta_at_depletion(fc: Column, wp: Column, allowed: float = 0.5) -> Column:
    return fc - F.lit(allowed) * (fc - wp)
