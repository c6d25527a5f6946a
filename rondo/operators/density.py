"""Densities, weighted grids, hole filling, blurring and contour lines as tables of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bins(c: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin, the last one closed on the right; 0 if the range is empty."""
    return F.when(hi > lo, F.least(F.floor((c - lo) / (hi - lo) * n), F.lit(n - 1))).otherwise(F.lit(0))


def ranges(points: DataFrame, cols=("x", "y")) -> DataFrame:
    return points.agg(*[f(c).alias(f"{p}{c}") for c in cols for f, p in ((F.min, "lo_"), (F.max, "hi_"))])


def density_2d(points: DataFrame, bins: int = 240) -> DataFrame:
    """Points with the count of their histogram cell. Cells are counted first, so a hot cell is one row of the join."""
    r = F.broadcast(ranges(points))  # one row
    p = points.crossJoin(r).withColumn("bx", _bins(F.col("x"), F.col("lo_x"), F.col("hi_x"), bins)).withColumn("by", _bins(F.col("y"), F.col("lo_y"), F.col("hi_y"), bins)).drop("lo_x", "hi_x", "lo_y", "hi_y")
    cells = p.groupBy("bx", "by").agg(F.count("*").alias("density"))
    return p.join(F.broadcast(cells), ["bx", "by"])  # at most bins * bins rows


def alpha(points: DataFrame, lo: float, span: float, flat: float, whole: bool, bins: int) -> DataFrame:
    """Opacity by density, min-max scaled to lo + span; `flat` where all densities are equal."""
    d = density_2d(points, bins)
    m = F.broadcast(d.agg(F.min("density").alias("mn"), F.max("density").alias("mx")))  # one row
    a = F.when(F.col("mx") > F.col("mn"), lo + span * (F.col("density") - F.col("mn")) / (F.col("mx") - F.col("mn"))).otherwise(flat)
    return d.crossJoin(m).withColumn("alpha", F.floor(a).cast("int") if whole else a).drop("mn", "mx")


def density_sphere(points: DataFrame, lat_bins: int = 120) -> DataFrame:
    """Unit vectors (x, y, z) with count over solid angle of their latitude-longitude cell."""
    pi = 3.141592653589793
    n = 2 * lat_bins
    lat, lon = F.asin(F.least(F.greatest("z", F.lit(-1.0)), F.lit(1.0))), F.atan2("y", "x")
    p = points.withColumn("bi", F.least(F.greatest(F.floor((lat + pi / 2) / pi * lat_bins), F.lit(0)), F.lit(lat_bins - 1))).withColumn("bj", F.least(F.greatest(F.floor((lon + pi) / (2 * pi) * n), F.lit(0)), F.lit(n - 1)))
    cells = p.groupBy("bi", "bj").agg(F.count("*").alias("n"))
    area = F.greatest(F.cos((F.col("bi") + 0.5) / lat_bins * pi - pi / 2) * (pi / lat_bins) * (2 * pi / n), F.lit(1e-8))
    return p.join(F.broadcast(cells.withColumn("density", F.col("n") / area).drop("n")), ["bi", "bj"])  # bounded by the bins


def boost(v: Column, hi: float, k: float, p: float, cap: float | None = None, lo: float | None = None, lk: float = 0.0, lp: float = 1.0) -> Column:
    """Weight of a value: more above a threshold (saturating below a cap) and, if asked, below another."""
    if cap is not None and cap > hi:
        t = F.least(F.greatest((v - hi) / (cap - hi), F.lit(0.0)), F.lit(1.0))
        w = 1 + k * F.tanh(p * t)
    else:
        w = 1 + k * F.pow(F.greatest(F.lit(0.0), v - hi), F.lit(p))
    return w if lo is None else w * (1 + lk * F.pow(F.greatest(F.lit(0.0), lo - v), F.lit(lp)))


def weighted_grid(points: DataFrame, weight: Column, gs: int, vmin: float, vmax: float) -> DataFrame:
    """(ix, iy, value): weighted mean of the clipped value in each cell."""
    gs = min(512, max(40, gs))
    r = F.broadcast(ranges(points))  # one row
    v = F.least(F.greatest("value", F.lit(vmin)), F.lit(vmax))
    ix, iy = (F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-12) * (gs - 1)).cast("int") for c in "xy")
    p = points.crossJoin(r).select(ix.alias("ix"), iy.alias("iy"), v.alias("v"), weight.alias("w"))
    return p.groupBy("ix", "iy").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"))


def dense(grid: DataFrame, gs: int) -> DataFrame:
    """All gs * gs cells, null where the grid has none."""
    n = grid.sparkSession.range(gs * gs).select((F.col("id") / gs).cast("int").alias("ix"), (F.col("id") % gs).cast("int").alias("iy"))
    return n.join(grid, ["ix", "iy"], "left")


def fill_holes(full: DataFrame, gs: int, passes: int = 1, compat: bool = False) -> DataFrame:
    """Empty cells take the mean of their eight neighbours (edges replicated), pass after pass. compat: a hole without neighbours becomes 0 at once.

    A grid has at most 512 * 512 cells, so all passes are one step on one array.
    """

    def fill(cells: pd.DataFrame) -> pd.DataFrame:
        a = np.full((gs, gs), np.nan)
        a[cells["ix"], cells["iy"]] = cells["value"].astype(float)
        for _ in range(passes):
            hole = np.isnan(a)
            if not hole.any():
                break
            around = np.pad(a, 1, mode="edge")
            near = np.stack([around[1 + x : 1 + x + gs, 1 + y : 1 + y + gs] for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y])
            n = (~np.isnan(near)).sum(0)
            mean = np.where(n > 0, np.nansum(near, axis=0) / np.maximum(n, 1), 0.0 if compat else np.nan)
            a = np.where(hole, mean, a)
        ix, iy = np.divmod(np.arange(gs * gs), gs)
        flat = a.ravel()
        return pd.DataFrame({"ix": ix, "iy": iy, "value": pd.Series(flat).astype(object).where(~np.isnan(flat), None)})

    return full.select("ix", "iy", F.col("value").cast("double")).groupBy(F.lit(0).alias("all")).applyInPandas(fill, "ix int, iy int, value double")


def box_blur(full: DataFrame, passes: int = 1) -> DataFrame:
    """3 x 3 mean with replicated edges: rows, then columns."""
    for _ in range(passes):
        for along, across in (("ix", "iy"), ("iy", "ix")):
            w = W.partitionBy(across).orderBy(along)
            v = F.col("value")
            full = full.withColumn("value", (F.coalesce(F.lag("value").over(w), v) + v + F.coalesce(F.lead("value").over(w), v)) / 3)
    return full


# The edges that a contour crosses for each of the 16 corner patterns (bits: lower left, lower right, upper
# right, upper left; edges: 0 bottom, 1 right, 2 top, 3 left). In 5 and 10 the high corners stay connected.
CROSSED = {1: [(3, 0)], 2: [(0, 1)], 3: [(3, 1)], 4: [(1, 2)], 5: [(3, 2), (0, 1)], 6: [(0, 2)], 7: [(3, 2)], 8: [(2, 3)], 9: [(2, 0)], 10: [(3, 0), (1, 2)], 11: [(2, 1)], 12: [(1, 3)], 13: [(1, 0)], 14: [(0, 3)]}


def marching_squares(full: DataFrame, levels: list[float], digits: int = 4) -> DataFrame:
    """(level, x0, y0, x1, y1): contour segments in cell units. Flat edges are cut in the middle; points are no segments."""
    wx, wy = W.partitionBy("iy").orderBy("ix"), W.partitionBy("ix").orderBy("iy")
    c = full.withColumn("b", F.lead("value").over(wx)).withColumn("d", F.lead("value").over(wy))
    c = c.withColumn("c", F.lead("d").over(wx)).withColumnRenamed("value", "a").filter("a is not null and b is not null and c is not null and d is not null")
    c = c.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    bit = lambda k, n: F.when(F.col(k) >= F.col("level"), n).otherwise(0)
    c = c.withColumn("code", bit("a", 1) + bit("b", 2) + bit("c", 4) + bit("d", 8)).filter("code between 1 and 14")

    def at(p: str, q: str) -> Column:
        return F.when(F.col(p) == F.col(q), 0.5).otherwise((F.col("level") - F.col(p)) / (F.col(q) - F.col(p)))

    x, y = F.col("ix").cast("double"), F.col("iy").cast("double")
    pts = F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in ((x + at("a", "b"), y), (x + 1, y + at("b", "c")), (x + at("d", "c"), y + 1), (x, y + at("a", "d")))])
    table = F.create_map(*[e for k, v in CROSSED.items() for e in (F.lit(k), F.array(*[F.struct(F.lit(a + 1).alias("p"), F.lit(b + 1).alias("q")) for a, b in v]))])
    s = c.withColumn("pts", pts).withColumn("e", F.explode(table[F.col("code")]))
    k = 10.0**digits
    r = lambda v: F.floor(v * k + 0.5) / k
    p, q = F.element_at("pts", F.col("e.p")), F.element_at("pts", F.col("e.q"))
    out = s.select("level", r(p["x"]).alias("x0"), r(p["y"]).alias("y0"), r(q["x"]).alias("x1"), r(q["y"]).alias("y1"))
    return out.filter("x0 <> x1 or y0 <> y1")


def simplify_segments(segments: DataFrame, quant: float, least: float = 0.0, every: int = 1) -> DataFrame:
    """Distinct segments on a grid of step `quant` whatever their direction, long enough, every n-th of each level."""
    q = lambda c: F.floor(F.col(c) / quant + 0.5) * quant
    s = segments.select("level", F.struct(q("x0").alias("x"), q("y0").alias("y")).alias("p"), F.struct(q("x1").alias("x"), q("y1").alias("y")).alias("q"))
    s = s.select("level", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).filter("p <> q").distinct()
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    s = s.filter(F.sqrt(dx * dx + dy * dy) >= least)
    n = F.row_number().over(W.partitionBy("level").orderBy("p", "q"))
    s = s.withColumn("n", n).filter((F.col("n") - 1) % every == 0) if every > 1 else s
    return s.select("level", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))
