"""Aggregates of whole maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram_entropy(n: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """Natural-log entropy of an equal-width histogram between each map's least and largest value (two values at least).

    Two aggregations, no list of values: ranges first, then counts per bin.
    """
    span = n.groupBy("map_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = n.filter(F.col(column).isNotNull()).join(span, "map_id").groupBy("map_id", "n", b.alias("b")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return counts.groupBy("map_id").agg(F.when(F.first("n") >= 2, F.sum(-p * F.ln(p))).alias(name))


def spatial_entropy(n: DataFrame, nx: int = 8, ny: int = 6, least: int = 4) -> DataFrame:
    """Entropy of the positions over a grid of the field; points outside don't count."""
    inside = n.filter((F.col("x") >= 0) & (F.col("x") <= 512) & (F.col("y") >= 0) & (F.col("y") <= 384))
    cell = inside.groupBy(
        "map_id", F.least(F.floor(F.col("x") / 512 * nx), F.lit(nx - 1)).alias("bx"), F.least(F.floor(F.col("y") / 384 * ny), F.lit(ny - 1)).alias("by")
    ).agg(F.count("*").alias("c"))
    # sum(-c/n ln(c/n)) = ln n - sum(c ln c) / n
    g = cell.groupBy("map_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return g.select("map_id", F.when(F.col("n") >= least, F.ln("n") - F.col("s") / F.col("n")).alias("spatial_entropy"))


def summary(n: DataFrame, stream_below: float = 80.0, jump_above: float = 200.0) -> DataFrame:
    """95th percentiles, fractions, counts by type, mean slider complexity. Needs speed, dt_prev, dist_prev, curvature."""
    of = lambda t: F.count_if(F.col("obj_type") == t)
    return n.groupBy("map_id").agg(
        F.count("*").alias("note_count"), of("circle").alias("count_circles"), of("slider").alias("count_sliders"), of("spinner").alias("count_spinners"),
        F.percentile("speed", 0.95).alias("speed_p95"), F.avg((F.col("dt_prev") < stream_below).cast("double")).alias("stream_fraction"),
        F.avg((F.col("dist_prev") > jump_above).cast("double")).alias("jump_fraction"), F.avg(1 - F.col("curvature")).alias("slider_complexity"),
    )


def value_variance(timing: DataFrame) -> DataFrame:
    """Population variance of the timing values, 0 for one."""
    return timing.groupBy("map_id").agg(F.when(F.count("value") < 2, 0.0).otherwise(F.var_pop("value")).alias("bpm_variance"))
