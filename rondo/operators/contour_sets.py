"""Contour sets of named metrics: ranges, levels and boosts by a small catalogue, then the grid operators one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from . import density as D
from .tags import auto_range, clamped_range

# Metric, number of levels, range (null: from the data).
CATALOGUE = (
    ("star", 15, 1.0, 15.0), ("ar", 11, 0.0, 10.0), ("od", 11, 0.0, 10.0), ("cs", 11, 0.0, 10.0), ("hp", 11, 0.0, 10.0),
    ("bpm", 16, None, None), ("density", 14, None, None), ("length", 14, None, None),
)
PERCENTILES = {"density": (0.10, 0.99), "length": (0.05, 0.98)}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOGUE), "metric string, levels int, lo double, hi double")


def metric_range(points: DataFrame, metric: str) -> tuple[float, float]:
    """The metric's range: fixed, or percentiles of its values. Two numbers reach the driver."""
    fixed = next(((lo, hi) for m, _, lo, hi in CATALOGUE if m == metric and lo is not None), None)
    if fixed:
        return fixed
    r = (clamped_range(points, "value") if metric == "bpm" else auto_range(points, "value", *PERCENTILES.get(metric, (0.02, 0.98)))).first()
    return (r["lo"], r["hi"]) if r["lo"] is not None else (0.0, 1.0)


def boost_of(metric: str, lo: float, hi: float, config: EngineConfig = EngineConfig()) -> Column:
    """Weight by value: stars above 8 up to the cap; others above 72 % of the range; beats per minute below 28 % of it too."""
    v = F.col("value")
    if metric == "star":
        return D.boost(v, 8.0, 1.4, config.star_boost_power, config.star_boost_cap or None)
    low = (lo + 0.28 * (hi - lo), 0.65, config.bpm_low_boost_power) if metric == "bpm" else (None, 0.0, 1.0)
    return D.boost(v, lo + 0.72 * (hi - lo), 0.65, 1.6, None, *low)


def contour_set(points: DataFrame, metric: str, gs: int = 180, smooth: int = 3, fill: int = 4, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(level, x0, y0, x1, y1) of all levels of a metric over points (x, y, value)."""
    gs = min(512, max(40, gs))
    known = points.filter("value is not null")
    lo, hi = metric_range(known, metric)
    n = next((k for m, k, _, _ in CATALOGUE if m == metric), 14)
    levels = [lo + (hi - lo) * i / (n - 1) for i in range(n)]
    grid = D.weighted_grid(known, boost_of(metric, lo, hi, config), gs, lo, hi)
    field = D.box_blur(D.fill_holes(D.dense(grid, gs), gs, fill), smooth)
    return D.marching_squares(field, levels)
