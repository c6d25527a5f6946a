"""Sliding windows whose length differs from map to map, and what is computed over them.

Boundaries are t0 + k * step, so a window's number follows from arithmetic: each event explodes into the few windows that can
hold it, and an exact filter decides. That is a projection, not a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ("map_id", "k", "start_ms", "end_ms")


def steps(beats: int, overlap: float) -> int:
    """Beats from one window's start to the next's."""
    return max(1, int(beats * (1 - overlap)))


def map_bounds(n: DataFrame, beat: str = "beat_ms") -> DataFrame:
    """First and last time, beat length and end of each map: one beat after the last event, 50 to 2000 ms."""
    g = n.groupBy("map_id").agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t_max"), F.first(beat).alias("beat_ms"))
    return g.withColumn("t_end", (F.col("t_max") + S.clamp(F.col("beat_ms"), 50.0, 2000.0)).cast("bigint"))


def _bounds(k: Column, beats: int, overlap: float) -> tuple[Column, Column]:
    t = F.col("t0") + k * (steps(beats, overlap) * F.col("beat_ms"))
    return t.cast("bigint"), F.least(F.col("t_end").cast("double"), t + beats * F.col("beat_ms")).cast("bigint")


def beat_windows(bounds: DataFrame, beats: int = 4, overlap: float = 0.5) -> DataFrame:
    """All windows (map_id, k, start_ms, end_ms); a map without a beat has none."""
    last = F.floor((F.col("t_end") - 1 - F.col("t0")) / (steps(beats, overlap) * F.col("beat_ms")))
    rows = bounds.filter("beat_ms > 0 and t_end - 1 >= t0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("k"))
    start, end = _bounds(F.col("k"), beats, overlap)
    return rows.select("map_id", "k", start.alias("start_ms"), end.alias("end_ms"))


def assign(n: DataFrame, bounds: DataFrame, beats: int = 4, overlap: float = 0.5) -> DataFrame:
    """Each event once for each window with start <= t < end.

    Events with a speed are numbered once over their map (column __i), where the rows are sorted already: within a window that
    number is the window's own but for a constant, which no slope depends on.
    """
    if "speed" in n.columns and "line_no" in n.columns:
        n = n.withColumn("__i", F.when(F.col("speed").isNotNull(), F.count("speed").over(W.partitionBy("map_id").orderBy("t_ms", "line_no").rowsBetween(W.unboundedPreceding, 0))))
    b = bounds.select("map_id", "t0", "t_end", F.col("beat_ms"))
    rows = n.drop("beat_ms").join(b, "map_id").filter("beat_ms > 0")
    step, length = steps(beats, overlap) * F.col("beat_ms"), beats * F.col("beat_ms")
    since = F.col("t_ms") - F.col("t0")
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor((since - length) / step))
    hi = F.floor((since + 1) / step)  # starts are cut down to whole ms
    rows = rows.withColumn("k", F.explode(F.sequence(lo, hi)))
    start, end = _bounds(F.col("k"), beats, overlap)
    return rows.withColumn("start_ms", start).withColumn("end_ms", end).filter("start_ms <= t_ms and t_ms < end_ms and start_ms + 1 <= t_end").drop("t0", "t_end")


def circular_variance(c: Column, s: Column, n: Column, least: int = 2) -> Column:
    """1 - mean resultant length, from mean cosine, mean sine and count."""
    return F.when(n >= least, 1 - F.sqrt(c * c + s * s))


def aggregates(rows: DataFrame, stream_below: float = 80.0, jump_above: float = 200.0) -> DataFrame:
    """Per window: count, finite means and maxima, slider share, circular variance of the bearing, slope of the speed and the
    change against the window before. rows: assigned events with the per-event features, from assign()."""
    rad = F.radians("bearing")
    g = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_obj"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("dt_prev", "dist_prev", "angle", "speed", "accel_mag", "jerk_mag", "dist_center")],
        F.max("speed").alias("speed_max"), F.avg((F.col("obj_type") == "slider").cast("double")).alias("pct_slider"),
        circular_variance(F.avg(F.cos(rad)), F.avg(F.sin(rad)), F.count("bearing")).alias("bearing_var"),
        F.when(F.count("speed") >= 3, F.regr_slope("speed", "__i")).alias("intensity_slope"),
    )
    kind = F.when(F.col("dt_prev_mean") < stream_below, 0).when(F.col("dist_prev_mean") > jump_above, 1).otherwise(2)
    g = g.withColumn("dominant", kind)
    logs = {f"log_{c}": S.log1p_positive(F.col(c)) for c in ("speed_mean", "speed_max", "accel_mag_mean", "jerk_mag_mean", "dt_prev_mean")}
    return transitions(g.withColumns(logs))


def transitions(g: DataFrame) -> DataFrame:
    """Change of mean speed and count against the map's previous non-empty window, and whether the dominant kind changed."""
    w = W.partitionBy("map_id").orderBy("start_ms", "k")
    return (
        g.withColumn("speed_delta", F.col("speed_mean") - F.lag("speed_mean").over(w))
        .withColumn("density_delta", F.col("n_obj") - F.lag("n_obj").over(w))
        .withColumn("pattern_switch", F.coalesce((F.col("dominant") != F.lag("dominant").over(w)).cast("int"), F.lit(0)))
    )


def feature_stats(rows: DataFrame, windows: DataFrame, columns: Sequence[str], limit: float = 1e6) -> DataFrame:
    """Mean, population deviation, minimum, maximum and median of every column in every window, clamped; long form.

    One aggregation for all columns; only medians need a window's values side by side, and a window is short. Windows without
    events keep their row, with nulls.
    """
    v = {c: S.finite(F.col(f"`{c}`").cast("double")) for c in columns}
    clean = rows.select("map_id", "k", *[x.alias(f"v{i}") for i, x in enumerate(v.values())])
    of = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "median": F.median}
    g = clean.groupBy("map_id", "k").agg(*[S.clamp(f(f"v{i}"), -limit, limit).alias(f"{s}{i}") for i in range(len(columns)) for s, f in of.items()])
    j = windows.select("map_id", "k").join(g, ["map_id", "k"], "left")
    each = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}{i}").alias(s) for s in of]) for i, c in enumerate(columns)])
    return j.select("map_id", "k", F.explode(each).alias("f")).select("map_id", "k", "f.*")


def feature_table(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wide form: one row per window, columns ts_{column}_{statistic}."""
    wide = stats.groupBy("map_id", "k").pivot("feature", list(columns)).agg(*[F.first(s).alias(s) for s in ("mean", "std", "min", "max", "median")])
    return wide.select("map_id", "k", *[F.col(f"`{c}_{s}`").alias(f"ts_{c}_{s}") for c in columns for s in ("mean", "std", "min", "max", "median")])


def type_fractions(rows: DataFrame) -> DataFrame:
    """Share of each event type, of each curve among sliders, and the base-2 entropy of the curves."""
    n_s = F.greatest(F.lit(1), F.count_if(F.col("obj_type") == "slider"))
    curves = ("L", "B", "C", "P")
    g = rows.groupBy("map_id", "k").agg(
        *[F.avg((F.col("obj_type") == t).cast("double")).alias(f"frac_{t}") for t in ("circle", "slider", "spinner")],
        *[(F.count_if((F.col("obj_type") == "slider") & (F.col("curve") == c)) / n_s).alias(f"curve_{c}") for c in curves],
    )
    h = sum(F.when(F.col(f"curve_{c}") > 0, -F.col(f"curve_{c}") * F.log2(f"curve_{c}")).otherwise(F.lit(0.0)) for c in curves)
    return g.withColumn("curve_entropy", h)


def circular_stats(rows: DataFrame, angle: str) -> DataFrame:
    """Circular variance and mean direction: one angle gives 0 and itself, none gives null."""
    rad = F.radians(angle)
    g = rows.groupBy("map_id", "k").agg(F.count(angle).alias("n"), F.avg(F.cos(rad)).alias("c"), F.avg(F.sin(rad)).alias("s"))
    return g.select(
        "map_id", "k", F.when(F.col("n") >= 2, S.clamp(1 - F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")), 0.0, 1.0)).when(F.col("n") == 1, 0.0).alias("circ_var"),
        F.when(F.col("n") >= 1, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).alias("circ_mean"),
    )


def overlap_labels(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """The distinct sorted labels of the spans (map_id, a, b, label) that overlap each window; an empty list if none."""
    s = spans.withColumnRenamed("map_id", "__map")
    j = windows.join(s, (F.col("map_id") == F.col("__map")) & (F.col("start_ms") < F.col("b")) & (F.col("end_ms") > F.col("a")), "left")
    return j.groupBy(*KEYS).agg(F.array_sort(F.collect_set("label")).alias("labels"))


def multi_hot(labelled: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tags with at least `least` windows, (map_id, k, tag, hot) for each window and kept tag)."""
    tags = labelled.select(F.explode("labels").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    kept = tags.agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    rows = labelled.crossJoin(F.broadcast(kept)).select("map_id", "k", "labels", F.explode("tags").alias("tag"))  # kept is one row
    return tags, rows.select("map_id", "k", "tag", F.array_contains("labels", F.col("tag")).cast("int").alias("hot"))


def negative_mask(labelled: DataFrame, negatives: DataFrame, tags: list[str]) -> DataFrame:
    """(map_id, k, y, n) of each window: y marks its labels among the tags, n the tags that its map is said not to have.

    labelled: windows with labels; negatives: (map_id, negative), an array each. A map without any has a mask of zeros.
    """
    one = negatives.groupBy("map_id").agg(F.array_distinct(F.flatten(F.collect_list("negative"))).alias("negative"))
    j = labelled.join(one, "map_id", "left")
    hot = lambda c: F.transform(F.array(*[F.lit(t) for t in tags]), lambda t: F.coalesce(F.array_contains(F.col(c), t), F.lit(False)).cast("int"))
    return j.select("map_id", "k", hot("labels").alias("y"), hot("negative").alias("n"))


def with_meta(windows: DataFrame, meta: DataFrame) -> DataFrame:
    """Every window with its map's metadata as columns meta_*; windows of maps without metadata keep nulls."""
    named = meta.select(F.col("map_id").alias("map_id_"), *[F.col(c).alias(f"meta_{c}") for c in meta.columns if c != "map_id"])
    return windows.join(named, F.col("map_id") == F.col("map_id_"), "left").drop("map_id_")


def full_features(base: DataFrame, meta: DataFrame, stats: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Window rows side by side with metadata and aggregated series, joined by window and not by position.

    columns: those to return, in order; what none of the parts has is null.
    """
    j = with_meta(base, meta).join(stats, ["map_id", "k"], "left")
    if columns is None:
        return j
    return j.select("map_id", "k", "start_ms", "end_ms", *[F.col(c) if c in j.columns else F.lit(None).cast("double").alias(c) for c in columns])


def attention_pool(rows: DataFrame, score: Column, value: Column) -> DataFrame:
    """Softmax-weighted mean of a value per map."""
    m = F.max("__s").over(W.partitionBy("map_id"))
    e = rows.withColumn("__s", score).withColumn("__v", value).withColumn("__e", F.exp(F.col("__s") - m))
    return e.groupBy("map_id").agg((F.sum(F.col("__e") * F.col("__v")) / F.sum("__e")).alias("pooled"))
