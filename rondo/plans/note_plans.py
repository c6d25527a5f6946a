"""Queries of the per-event window operators."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded as R
from ..operators import notes as N
from .adapters import DELTAS_SQL, HOUR, NOTES_SQL, SLIDERS_SQL, notes, r, slider_notes
from .registry import query

W_SQL = "WINDOW w AS (PARTITION BY map_id ORDER BY t_ms, line_no)"
TURN_SQL = "(degrees(atan2(lead(y) OVER w - y, lead(x) OVER w - x) - atan2(y - lag(y) OVER w, x - lag(x) OVER w)) % 360 + 360) % 360"


@query("note_deltas", f"WITH {DELTAS_SQL} SELECT map_id, line_no, obj_idx, dt_prev, {r('dist_prev')} AS dist_prev, {r('dist_prev / 640')} AS dist_prev_norm FROM d")
def note_deltas(spark, sf):
    d = N.index(N.deltas(notes(spark, sf)))
    return d.select("map_id", "line_no", F.col("obj_idx").cast("bigint").alias("obj_idx"), "dt_prev", R(F.col("dist_prev")).alias("dist_prev"), R(F.col("dist_prev_norm")).alias("dist_prev_norm"))


@query("turning_angles", f"""WITH {NOTES_SQL}, a AS (SELECT *, {TURN_SQL} AS angle FROM notes {W_SQL})
SELECT map_id, line_no, {r('angle', 4)} AS angle, CASE WHEN angle IS NULL THEN -1 WHEN angle < 30 OR angle > 330 THEN 0
  WHEN angle BETWEEN 150 AND 210 THEN 1 WHEN angle BETWEEN 50 AND 130 THEN 2 ELSE 3 END AS jump_type FROM a""")
def turning_angles(spark, sf):
    return N.angles(notes(spark, sf)).select("map_id", "line_no", R(F.col("angle"), 4).alias("angle"), "jump_type")


@query("angle_variance", f"""WITH {NOTES_SQL}, a AS (SELECT *, {TURN_SQL} AS angle, row_number() OVER w - 1 AS i FROM notes {W_SQL}),
v AS (SELECT *, CASE WHEN i >= 2 THEN var_pop(angle) OVER (PARTITION BY map_id ORDER BY t_ms, line_no ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS v FROM a)
SELECT map_id, line_no, {r('v', 3)} AS angle_var FROM v""")
def angle_variance(spark, sf):
    return N.angle_variance(notes(spark, sf)).select("map_id", "line_no", R(F.col("angle_var"), 3).alias("angle_var"))


def _inner_sql(a, b, c):
    u = f"(({a}x - {b}x) * ({c}x - {b}x) + ({a}y - {b}y) * ({c}y - {b}y))"
    du, dv = (f"sqrt(({p}x - {b}x) * ({p}x - {b}x) + ({p}y - {b}y) * ({p}y - {b}y))" for p in (a, c))
    return f"CASE WHEN {du} > 0 AND {dv} > 0 THEN degrees(acos(least(1e0, greatest(-1e0, {u} / ({du} * {dv}))))) END"


@query("poly_squareness", f"""WITH {NOTES_SQL}, p AS (SELECT *, x AS p3x, y AS p3y, {', '.join(f'lag({c}, {k}) OVER w AS p{3 - k}{c}' for k in (1, 2, 3) for c in 'xy')} FROM notes {W_SQL}),
o AS (SELECT *, abs({_inner_sql('p0', 'p1', 'p2')} - 90) + abs({_inner_sql('p1', 'p2', 'p3')} - 90) AS off FROM p)
SELECT map_id, line_no, {r('CASE WHEN off IS NOT NULL THEN greatest(0e0, 1 - off / 180) END')} AS poly_sq FROM o""")
def poly_squareness(spark, sf):
    return N.squareness(notes(spark, sf)).select("map_id", "line_no", R(F.col("poly_sq")).alias("poly_sq"))


@query("asof_local_timing", f"""WITH {NOTES_SQL}, t AS (SELECT map_id, t_ms, line_no, 60 + k::DOUBLE AS bpm FROM notes WHERE event_type = 'signup'),
f AS (SELECT map_id, arg_min(bpm, (t_ms, line_no)) AS first_bpm, min(t_ms) AS t0 FROM t GROUP BY map_id),
n AS (SELECT * FROM notes WHERE event_type <> 'signup'),
j AS (SELECT n.*, t.bpm FROM n ASOF LEFT JOIN t ON n.map_id = t.map_id AND n.t_ms >= t.t_ms)
SELECT j.map_id, line_no, coalesce(bpm, first_bpm, 120e0) AS local_bpm, {r("(((j.t_ms - coalesce(t0, 0)) % beat_ms + beat_ms) % beat_ms) / beat_ms")} AS beat_rel
FROM j LEFT JOIN f ON j.map_id = f.map_id""")
def asof_local_timing(spark, sf):
    n = notes(spark, sf)
    timing = n.filter("event_type = 'signup'").select("map_id", "t_ms", "line_no", (60 + F.col("k").cast("double")).alias("value"))
    d = N.beat_phase(N.asof_timing(n.filter("event_type <> 'signup'"), timing))
    return d.select("map_id", "line_no", F.col("local_value").alias("local_bpm"), R(F.col("beat_rel")).alias("beat_rel"))


@query("slider_shape", f"""WITH {SLIDERS_SQL} SELECT map_id, line_no, {r('slider_dur', 3)} AS slider_dur, {r('slider_vel', 9)} AS slider_vel, {r('slider_vel * (beat_ms / 16)')} AS slider_vel_beats,
 {r('anchor_density', 9)} AS anchor_density, {r('slider_dir', 4)} AS slider_dir, {r('curvature')} AS curvature, slider_end_x, slider_end_y FROM s WHERE obj_type = 'slider'""")
def slider_shape(spark, sf):
    d = N.slider_shape(slider_notes(spark, sf)).filter("obj_type = 'slider'")
    return d.select("map_id", "line_no", R(F.col("slider_dur"), 3).alias("slider_dur"), R(F.col("slider_vel"), 9).alias("slider_vel"), R(F.col("slider_vel_beats")).alias("slider_vel_beats"),
                    R(F.col("anchor_density"), 9).alias("anchor_density"), R(F.col("slider_dir"), 4).alias("slider_dir"), R(F.col("curvature")).alias("curvature"), "slider_end_x", "slider_end_y")


def _kinematics_sql(select: str, strict: bool = False) -> str:
    moved = "obj_type = 'slider' AND slider_dur IS NOT NULL AND slider_end_x IS NOT NULL" + (" AND slider_dur > 0" if strict else "")
    step = lambda name, of, src: f"{name} AS (SELECT *, " + ", ".join(f"CASE WHEN dt_eff > 0 THEN ({of}_{a} - lag({of}_{a}) OVER w) / dt_eff END AS {name}_{a}" for a in "xy") + f" FROM {src} {W_SQL})"
    return f"""WITH {SLIDERS_SQL}, e AS (SELECT *, CASE WHEN {moved} THEN slider_end_x ELSE x END AS ex, CASE WHEN {moved} THEN slider_end_y ELSE y END AS ey,
  CASE WHEN {moved} THEN t_ms + slider_dur ELSE t_ms::DOUBLE END AS et FROM s),
e2 AS (SELECT *, t_ms - lag(et) OVER w AS dt_eff, lag(ex) OVER w AS px, lag(ey) OVER w AS py FROM e {W_SQL}),
vel AS (SELECT *, CASE WHEN dt_eff > 0 THEN (x - px) / dt_eff END AS vel_x, CASE WHEN dt_eff > 0 THEN (y - py) / dt_eff END AS vel_y FROM e2),
{step('accel', 'vel', 'vel')}, {step('jerk', 'accel', 'accel')}, {step('jounce', 'jerk', 'jerk')}
SELECT {select} FROM jounce"""


MAG = lambda of, k: f"floor(sqrt({of}_x * {of}_x + {of}_y * {of}_y) * {k} * 1e6 + 5e-1) / 1e6"


@query("kinematics", _kinematics_sql(f"map_id, line_no, {MAG('vel', '1e6')} AS speed, {MAG('accel', '1e12')} AS accel_mag, {MAG('jerk', '1e18')} AS jerk_mag, {MAG('jounce', '1e24')} AS jounce_mag, {r('(degrees(atan2(vel_y, vel_x)) % 360 + 360) % 360', 4)} AS bearing"))
def kinematics(spark, sf):
    d = N.kinematics(N.slider_shape(slider_notes(spark, sf)))
    return d.select("map_id", "line_no", R(F.col("speed") * 1e6).alias("speed"), R(F.col("accel_mag") * 1e12).alias("accel_mag"), R(F.col("jerk_mag") * 1e18).alias("jerk_mag"),
                    R(F.col("jounce_mag") * 1e24).alias("jounce_mag"), R(F.col("bearing"), 4).alias("bearing"))


@query("kinematics_repair", _kinematics_sql(f"map_id, line_no, {r('vel_x * 1e6')} AS vel_x, {r('vel_y * 1e6')} AS vel_y", True))
def kinematics_repair(spark, sf):
    d = N.kinematics(N.slider_shape(slider_notes(spark, sf)), strict=True)
    return d.select("map_id", "line_no", R(F.col("vel_x") * 1e6).alias("vel_x"), R(F.col("vel_y") * 1e6).alias("vel_y"))


@query("absement_absity", f"""WITH {DELTAS_SQL}, g AS (SELECT *, CASE WHEN dt_prev > 0 THEN dt_prev ELSE 0 END / 3600000e0 AS h FROM d),
a AS (SELECT *, sum(x * h) OVER w AS ax, sum(y * h) OVER w AS ay FROM g WINDOW w AS (PARTITION BY map_id ORDER BY t_ms, line_no ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, sum(ax * h) OVER w AS bx, sum(ay * h) OVER w AS by_ FROM a WINDOW w AS (PARTITION BY map_id ORDER BY t_ms, line_no ROWS UNBOUNDED PRECEDING))
SELECT map_id, line_no, {r('ax', 3)} AS absement_x, {r('ay', 3)} AS absement_y, {r('bx', 2)} AS absity_x, {r('by_', 2)} AS absity_y FROM b""")
def absement_absity(spark, sf):
    d = N.absement(N.deltas(notes(spark, sf)).withColumn("dt_prev", F.col("dt_prev") / HOUR))
    return d.select("map_id", "line_no", *[R(F.col(f"{a}_{c}"), k).alias(f"{a}_{c}") for a, k in (("absement", 3), ("absity", 2)) for c in "xy"])


@query("visual_density", f"""WITH {NOTES_SQL} SELECT map_id, line_no, count(*) OVER (PARTITION BY map_id ORDER BY t_ms RANGE BETWEEN preempt_ms PRECEDING AND CURRENT ROW) AS vis_density FROM notes""")
def visual_density(spark, sf):
    return N.visual_density(notes(spark, sf)).select("map_id", "line_no", "vis_density")


@query("center_variance", f"""WITH {NOTES_SQL}, c AS (SELECT *, sqrt((x - 256) * (x - 256) + (y - 192) * (y - 192)) AS dc FROM notes),
v AS (SELECT *, CASE WHEN count(dc) OVER w >= 3 THEN var_pop(dc) OVER w END AS v FROM c WINDOW w AS (PARTITION BY map_id ORDER BY t_ms, line_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT map_id, line_no, {r('dc')} AS dist_center, {r('v', 3)} AS dist_center_var, (x >= 256)::INT + 2 * (y >= 192)::INT AS quadrant, {r('least(x, 512 - x, greatest(0e0, y), 384 - y) / 192')} AS edge_proximity FROM v""")
def center_variance(spark, sf):
    d = N.center_stats(notes(spark, sf))
    return d.select("map_id", "line_no", R(F.col("dist_center")).alias("dist_center"), R(F.col("dist_center_var"), 3).alias("dist_center_var"), "quadrant", R(F.col("edge_proximity")).alias("edge_proximity"))


RING_SQL = DELTAS_SQL + """, q AS (SELECT map_id, line_no, t_ms, list(dt_prev::DOUBLE) OVER (PARTITION BY map_id ORDER BY t_ms, line_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS ring FROM d WHERE dt_prev > 0),
ringed AS (SELECT d.*, coalesce(last_value(q.ring IGNORE NULLS) OVER (PARTITION BY d.map_id ORDER BY d.t_ms, d.line_no ROWS UNBOUNDED PRECEDING), []) AS ring, lag(dt_prev) OVER (PARTITION BY d.map_id ORDER BY d.t_ms, d.line_no) AS before
 FROM d LEFT JOIN q ON d.map_id = q.map_id AND d.line_no = q.line_no)"""


@query("dt_ring_stats", f"""WITH {RING_SQL} SELECT map_id, line_no, {r('CASE WHEN len(ring) >= 3 AND list_avg(ring) > 0 THEN list_stddev_pop(ring) / list_avg(ring) END', 5)} AS dt_cv,
 {r('CASE WHEN before > 0 THEN dt_prev / before::DOUBLE END')} AS dt_ratio, {r('CASE WHEN dt_prev > 0 THEN 60000e0 / dt_prev * 1e6 END')} AS bpm_local_e6, coalesce(dt_prev < 3600000, false)::INT AS is_stream,
 coalesce(len(ring) >= 4 AND ring[-1] >= 36000000 AND len(list_filter(ring[:-2], lambda g: g < 28800000)) >= 3, false)::INT AS is_burst FROM ringed""")
def dt_ring_stats(spark, sf):
    d = N.ring_stats(notes(spark, sf), stream_below=1.0 * HOUR, burst_gap=10.0 * HOUR, burst_below=8.0 * HOUR)
    return d.select("map_id", "line_no", R(F.col("dt_cv"), 5).alias("dt_cv"), R(F.col("dt_ratio")).alias("dt_ratio"), R(F.col("bpm_local") * 1e6).alias("bpm_local_e6"), "is_stream", "is_burst")


@query("rhythm_entropy_rolling", f"""WITH {RING_SQL}, u AS (SELECT map_id, line_no, len(ring) AS n, list_min(ring) AS lo, list_max(ring) AS hi, unnest(CASE WHEN len(ring) = 0 THEN [NULL] ELSE ring END) AS g FROM ringed),
b AS (SELECT map_id, line_no, n, lo, hi, CASE WHEN hi > lo THEN least(floor((g - lo) / (hi - lo) * 6), 5) END AS b, count(*) AS c FROM u GROUP BY ALL),
e AS (SELECT map_id, line_no, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, -sum(c / n::DOUBLE * ln(c / n::DOUBLE)) AS h FROM b GROUP BY map_id, line_no)
SELECT map_id, line_no, {r('CASE WHEN n < 3 THEN NULL WHEN hi = lo THEN 0 ELSE h END')} AS rhythm_complexity FROM e""")
def rhythm_entropy_rolling(spark, sf):
    return N.ring_entropy(notes(spark, sf)).select("map_id", "line_no", R(F.col("rhythm_complexity")).alias("rhythm_complexity"))


@query("strain_lookup", f"""WITH {NOTES_SQL}, s AS (SELECT map_id, (t_ms // 3600000) * 3600000 AS b, max(x) AS aim, max(y) AS speed FROM notes WHERE event_type = 'click' GROUP BY ALL)
SELECT n.map_id, n.line_no, aim, speed FROM notes n LEFT JOIN s ON n.map_id = s.map_id AND (n.t_ms // 3600000) * 3600000 = s.b""")
def strain_lookup(spark, sf):
    n = notes(spark, sf)
    strains = n.filter("event_type = 'click'").groupBy("map_id", (F.floor(F.col("t_ms") / HOUR) * HOUR).alias("bucket_ms")).agg(F.max("x").alias("aim"), F.max("y").alias("speed"))
    return N.strain_lookup(n, strains, HOUR).select("map_id", "line_no", "aim", "speed")
