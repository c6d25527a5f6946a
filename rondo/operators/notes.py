"""Per-event features of ordered sequences: all windows share one partitioning and order, hence one exchange and one sort.

Input rows have map_id, t_ms, line_no, x, y and, where sliders matter, obj_type, slider_end_x, slider_end_y, slider_dur.
Missing is NULL. Order is (t_ms, line_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

ORDER = ("t_ms", "line_no")


def by_map(order: tuple[str, ...] = ORDER):
    return W.partitionBy("map_id").orderBy(*order)


def index(n: DataFrame) -> DataFrame:
    return n.withColumn("obj_idx", F.row_number().over(by_map()) - 1)


def deltas(n: DataFrame) -> DataFrame:
    """dt_prev, dist_prev and its share of the diagonal; null on the first."""
    w = by_map()
    return n.withColumn("dt_prev", F.col("t_ms") - F.lag("t_ms").over(w)).withColumn(
        "dist_prev", S.length2(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    ).withColumn("dist_prev_norm", F.col("dist_prev") / S.DIAGONAL)


def angles(n: DataFrame) -> DataFrame:
    """Turning angle (needs both neighbours) and jump type."""
    w = by_map()
    dx1, dy1 = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    dx2, dy2 = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    return n.withColumn("angle", S.turn(dx1, dy1, dx2, dy2)).withColumn("jump_type", S.jump_type(F.col("angle")))


def angle_variance(n: DataFrame) -> DataFrame:
    """Variance of up to six angles up to this one, from the third event on. The frame clips itself: end angles are null."""
    return index(angles(n)).withColumn("angle_var", F.when(F.col("obj_idx") >= 2, F.var_pop("angle").over(by_map().rowsBetween(-5, 0))))


def squareness(n: DataFrame) -> DataFrame:
    """How near the inner angles of the last four points are to right angles; null if a side has no length."""
    w = by_map()
    p = [(F.lag("x", k).over(w), F.lag("y", k).over(w)) for k in (3, 2, 1)] + [(F.col("x"), F.col("y"))]

    def inner(a, b, c) -> Column:
        ux, uy, vx, vy = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
        du, dv = S.length2(ux, uy), S.length2(vx, vy)
        return F.when((du > 0) & (dv > 0), F.degrees(F.acos(S.clamp((ux * vx + uy * vy) / (du * dv), -1.0, 1.0))))

    off = F.abs(inner(*p[:3]) - 90) + F.abs(inner(*p[1:]) - 90)
    return n.withColumn("poly_sq", F.when(off.isNotNull(), F.greatest(F.lit(0.0), 1 - off / 180)))


def asof_timing(n: DataFrame, timing: DataFrame, default: float = 120.0) -> DataFrame:
    """The last timing value at or before each event (ties: the last line), before the first one its value, else the default.

    timing: (map_id, t_ms, line_no, value). Both go through one window: no range join.
    """
    marked = n.withColumn("__value", F.lit(None).cast("double")).withColumn("__note", F.lit(1)).unionByName(
        timing.select("map_id", "t_ms", "line_no", F.col("value").alias("__value"), F.lit(0).alias("__note")), allowMissingColumns=True
    )
    w = W.partitionBy("map_id").orderBy("t_ms", "__note", "line_no")
    first = F.first("__value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last("__value", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    t0 = F.coalesce(F.min(F.when(F.col("__note") == 0, F.col("t_ms"))).over(W.partitionBy("map_id")), F.lit(0))
    return marked.withColumn("local_value", F.coalesce(last, first, F.lit(default))).withColumn("timing_start", t0).filter("__note = 1").drop("__value", "__note")


def beat_phase(n: DataFrame, beat_ms: str = "beat_ms", start: str = "timing_start") -> DataFrame:
    return n.withColumn("beat_rel", F.pmod((F.col("t_ms") - F.col(start)).cast("double"), F.col(beat_ms)) / F.col(beat_ms))


def slider_shape(n: DataFrame, multiplier: float = 1.4) -> DataFrame:
    """Duration, velocity, anchor density, direction, curvature and end of sliders (null for other events)."""
    is_s = F.col("obj_type") == "slider"
    dur = S.slider_duration(F.col("slider_len"), F.lit(multiplier), F.col("sv"), F.col("beat_ms"), F.col("slider_repeats"))
    odd = (F.col("slider_repeats") % 2 == 1) & F.col("la_x").isNotNull()
    return (
        n.withColumn("slider_dur", F.when(is_s, dur))
        .withColumn("slider_vel", F.when(is_s, F.col("slider_len") / F.greatest(F.lit(1.0), F.col("slider_dur"))))
        .withColumn("slider_vel_beats", F.col("slider_vel") * F.col("beat_ms"))
        .withColumn("anchor_density", F.when(is_s, F.col("slider_anchors") / F.greatest(F.lit(1.0), F.col("slider_dur")) * 1000))
        .withColumn("slider_dir", F.when(is_s & ((F.abs(F.col("fa_x") - F.col("x")) > 0.5) | (F.abs(F.col("fa_y") - F.col("y")) > 0.5)), S.bearing(F.col("fa_x") - F.col("x"), F.col("fa_y") - F.col("y"))))
        .withColumn("curvature", F.when(is_s & F.col("la_x").isNotNull(), F.least(F.lit(1.0), S.length2(F.col("la_x") - F.col("x"), F.col("la_y") - F.col("y")) / F.greatest(F.lit(1.0), F.col("slider_len")))))
        .withColumn("slider_end_x", F.when(is_s, F.when(odd, F.col("la_x")).otherwise(F.col("x"))))
        .withColumn("slider_end_y", F.when(is_s, F.when(odd, F.col("la_y")).otherwise(F.col("y"))))
    )


#: The largest float32.
F32_MAX = 3.4028234663852886e38


def derived_slider_columns(n: DataFrame) -> DataFrame:
    """Slider columns that tables of old builds lack, from those they have; a column that is there already stays.

    Duration is length over velocity, velocity per beat is velocity times 60000 / bpm, the direction's cosine and sine are
    its place on the circle. Without their source columns they aren't added; events without them keep nulls.
    """
    have = set(n.columns)
    out = {}
    number = lambda c: F.col(c).cast("double")
    if "slider_dur_ms" not in have and {"slider_len_px", "slider_vel"} <= have:
        out["slider_dur_ms"] = S.clamp(F.when(number("slider_vel") > 1e-6, number("slider_len_px") / number("slider_vel")), -F32_MAX, F32_MAX)
    if "slider_vel_beats" not in have and {"slider_vel", "local_bpm"} <= have:
        out["slider_vel_beats"] = S.clamp(F.when(number("local_bpm") > 0.1, number("slider_vel") * (60000.0 / number("local_bpm"))), -F32_MAX, F32_MAX)
    if "slider_dir_deg" in have and "slider_dir_circ_x" not in have:
        out["slider_dir_circ_x"], out["slider_dir_circ_y"] = F.cos(F.radians(number("slider_dir_deg"))), F.sin(F.radians(number("slider_dir_deg")))
    return n.withColumns({c: v.cast("float") for c, v in out.items()}) if out else n


def kinematics(n: DataFrame, strict: bool = False) -> DataFrame:
    """Velocity from the effective previous position, then acceleration, jerk and jounce; bearing. A gap resets the chain.

    strict: a slider counts as moved only if its duration is positive (the repair of old tables).
    """
    w = by_map()
    moved = (F.col("obj_type") == "slider") & F.col("slider_dur").isNotNull() & F.col("slider_end_x").isNotNull()
    if strict:
        moved = moved & (F.col("slider_dur") > 0)
    end = {
        "__ex": F.when(moved, F.col("slider_end_x")).otherwise(F.col("x")),
        "__ey": F.when(moved, F.col("slider_end_y")).otherwise(F.col("y")),
        "__et": F.when(moved, F.col("t_ms") + F.col("slider_dur")).otherwise(F.col("t_ms").cast("double")),
    }
    d = n.withColumns(end).withColumn("dt_eff", F.col("t_ms") - F.lag("__et").over(w))
    ok = F.col("dt_eff") > 0
    d = d.withColumn("vel_x", F.when(ok, (F.col("x") - F.lag("__ex").over(w)) / F.col("dt_eff"))).withColumn(
        "vel_y", F.when(ok, (F.col("y") - F.lag("__ey").over(w)) / F.col("dt_eff"))
    )
    for name, of in (("accel", "vel"), ("jerk", "accel"), ("jounce", "jerk")):
        for a in "xy":
            d = d.withColumn(f"{name}_{a}", F.when(ok, (F.col(f"{of}_{a}") - F.lag(f"{of}_{a}").over(w)) / F.col("dt_eff")))
    for name, of in (("speed", "vel"), ("accel_mag", "accel"), ("jerk_mag", "jerk"), ("jounce_mag", "jounce")):
        d = d.withColumn(name, S.length2(F.col(f"{of}_x"), F.col(f"{of}_y")))
    return d.withColumn("bearing", S.bearing(F.col("vel_x"), F.col("vel_y"))).drop("__ex", "__ey", "__et")


def absement(n: DataFrame, dt: str = "dt_prev") -> DataFrame:
    """Running integral of the position over positive gaps, and the integral of that."""
    run = by_map().rowsBetween(W.unboundedPreceding, 0)
    gap = F.when(F.col(dt) > 0, F.col(dt)).otherwise(F.lit(0)).cast("double")
    out = n
    for a in "xy":
        out = out.withColumn(f"absement_{a}", F.sum(F.col(a) * gap).over(run))
    for a in "xy":
        out = out.withColumn(f"absity_{a}", F.sum(F.col(f"absement_{a}") * gap).over(run))
    return out


def visual_density(n: DataFrame, preempt: str = "preempt_ms") -> DataFrame:
    """Events with t in [t - preempt, t], ties on both sides. A frame of varying width: markers at t - preempt, one running count."""
    events = n.select("map_id", F.col("t_ms").alias("at"), F.lit(1).alias("one"), F.lit(1).alias("kind"), "line_no")
    marks = n.select("map_id", (F.col("t_ms") - F.col(preempt)).alias("at"), F.lit(0).alias("one"), F.lit(0).alias("kind"), "line_no")
    # Markers come before events of the same time, so they count what is strictly earlier.
    w = W.partitionBy("map_id").orderBy("at", "kind", "line_no").rowsBetween(W.unboundedPreceding, 0)
    counted = events.union(marks).withColumn("upto", F.sum("one").over(w))
    at_end = counted.filter("kind = 1").withColumn("upto", F.max("upto").over(W.partitionBy("map_id", "at")))
    both = at_end.union(counted.filter("kind = 0")).groupBy("map_id", "line_no").agg(
        (F.max(F.when(F.col("kind") == 1, F.col("upto"))) - F.max(F.when(F.col("kind") == 0, F.col("upto")))).alias("vis_density")
    )
    return n.join(both, ["map_id", "line_no"])


def center_stats(n: DataFrame) -> DataFrame:
    """Distance from the centre with its variance over eight events (three at least), quadrant and edge proximity."""
    w = by_map().rowsBetween(-7, 0)
    d = n.withColumn("dist_center", S.center_distance(F.col("x"), F.col("y")))
    return (
        d.withColumn("dist_center_norm", F.col("dist_center") / S.HALF_DIAGONAL)
        .withColumn("dist_center_var", F.when(F.count("dist_center").over(w) >= 3, F.var_pop("dist_center").over(w)))
        .withColumn("quadrant", S.quadrant(F.col("x"), F.col("y"))).withColumn("edge_proximity", S.edge_proximity(F.col("x"), F.col("y")))
    )


def gap_ring(n: DataFrame) -> DataFrame:
    """ring: the last eight positive gaps up to each event; other gaps leave it as it is.

    A frame over all rows can't skip rows, so each row numbers its positive gaps and takes the last eight of a running slice.
    """
    d = deltas(n) if "dt_prev" not in n.columns else n
    w = by_map()
    d = d.withColumn("__pos", F.when(F.col("dt_prev") > 0, 1).otherwise(0))
    # Within the rows of a map that have a positive gap the frame is eight rows; then carry forward.
    part = W.partitionBy("map_id", "__pos").orderBy(*ORDER).rowsBetween(-7, 0)
    d = d.withColumn("__ring", F.when(F.col("__pos") == 1, F.collect_list(F.col("dt_prev").cast("double")).over(part)))
    ring = F.last("__ring", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("ring", F.coalesce(ring, F.array().cast("array<double>"))).drop("__pos", "__ring")


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def ring_stats(n: DataFrame, stream_below: float = 80.0, burst_gap: float = 150.0, burst_below: float = 100.0, burst_votes: int = 3) -> DataFrame:
    """Statistics of the ring of gaps and of the present gap."""
    d = gap_ring(n)
    w = by_map()
    r, size = F.col("ring"), F.size("ring")
    mean = _mean(r)
    var = F.aggregate(F.transform(r, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / size
    before = F.lag("dt_prev").over(w)
    earlier = F.slice(r, 1, F.greatest(size - 1, F.lit(0)))
    burst = (size >= 4) & (F.element_at(r, -1) >= burst_gap) & (F.size(F.filter(earlier, lambda x: x < burst_below)) >= burst_votes)
    return (
        d.withColumn("dt_cv", F.when((size >= 3) & (mean > 0), F.sqrt(var) / mean))
        .withColumn("dt_ratio", F.when(before > 0, F.col("dt_prev") / before))
        .withColumn("bpm_local", F.when(F.col("dt_prev") > 0, 60000.0 / F.col("dt_prev")))
        .withColumn("is_stream", F.coalesce(F.col("dt_prev") < stream_below, F.lit(False)).cast("int"))
        .withColumn("is_burst", F.coalesce(burst, F.lit(False)).cast("int"))
    )


def ring_entropy(n: DataFrame, bins: int = 6, least: int = 3) -> DataFrame:
    """Natural-log entropy of an equal-width histogram of the ring; 0 if constant, null under `least` values."""
    d = gap_ring(n)
    r, size = F.col("ring"), F.size("ring")
    lo, hi = F.array_min(r), F.array_max(r)
    bin_of = F.transform(r, lambda x: F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    parts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(bin_of, lambda x: x == b)) / size)
    h = F.aggregate(F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.ln(p))
    return d.withColumn("rhythm_complexity", F.when(size < least, None).when(hi == lo, 0.0).otherwise(h))


def strain_lookup(n: DataFrame, strains: DataFrame, section_ms: int) -> DataFrame:
    """Equality look-up of a series on floor(t / section) * section; null where it has no value."""
    at = n.withColumn("bucket_ms", F.floor(F.col("t_ms") / section_ms) * section_ms)
    return at.join(strains, ["map_id", "bucket_ms"], "left")
