"""Queries of the sliding windows, their features, and whole-map statistics."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded as R
from ..operators import map_stats as G
from ..operators import notes as N
from ..operators import windows as B
from .adapters import HOUR, NOTES_SQL, SLIDERS_SQL, notes, r, slider_notes
from .registry import query

WIN_SQL = """bounds AS (SELECT map_id, min(t_ms) AS t0, max(t_ms) AS t_max, any_value(beat_ms) AS beat_ms, (max(t_ms) + least(greatest(any_value(beat_ms), 50), 2000))::BIGINT AS t_end FROM notes GROUP BY map_id),
win AS (SELECT map_id, k, (t0 + k * 2 * beat_ms)::BIGINT AS start_ms, least(t_end::DOUBLE, t0 + k * 2 * beat_ms + 4 * beat_ms)::BIGINT AS end_ms
  FROM (SELECT *, unnest(generate_series(0, floor((t_end - 1 - t0) / (2 * beat_ms))::BIGINT)) AS k FROM bounds)),
rows_ AS (SELECT n.* EXCLUDE (k), w.k, w.start_ms, w.end_ms FROM feat n JOIN win w ON n.map_id = w.map_id AND w.start_ms <= n.t_ms AND n.t_ms < w.end_ms)"""

FEAT_SQL = NOTES_SQL + """, f0 AS (SELECT *, t_ms - lag(t_ms) OVER w AS dt_prev, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey FROM notes
  WINDOW w AS (PARTITION BY map_id ORDER BY t_ms, line_no)),
f1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist_prev, (degrees(atan2(ey, ex) - atan2(dy, dx)) % 360 + 360) % 360 AS angle, sqrt((x - 256) * (x - 256) + (y - 192) * (y - 192)) AS dist_center,
  CASE WHEN dt_prev > 0 THEN dx / (dt_prev / 3600000e0) END AS vx, CASE WHEN dt_prev > 0 THEN dy / (dt_prev / 3600000e0) END AS vy FROM f0),
feat AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, (degrees(atan2(vy, vx)) % 360 + 360) % 360 AS bearing FROM f1)"""


def features(spark, sf):
    """Notes with gap, distance, angle, distance from the centre, and speed per hour."""
    n = N.center_stats(N.angles(N.deltas(notes(spark, sf))))
    k = N.kinematics(n.withColumns({"slider_dur": F.lit(None).cast("double"), "slider_end_x": F.lit(None).cast("double"), "slider_end_y": F.lit(None).cast("double")}))
    scale = {"speed": HOUR, "accel_mag": HOUR**2, "jerk_mag": HOUR**3}
    return k.withColumns({c: F.col(c) * float(m) for c, m in scale.items()})


def assigned(spark, sf, n=None):
    n = n if n is not None else features(spark, sf)
    return B.assign(n.drop("k"), B.map_bounds(notes(spark, sf)))


@query("beat_windows", f"WITH {NOTES_SQL}, feat AS (SELECT * FROM notes), {WIN_SQL} SELECT map_id, k, start_ms, end_ms FROM win")
def beat_windows(spark, sf):
    return B.beat_windows(B.map_bounds(notes(spark, sf)))


@query("window_assignment", f"WITH {NOTES_SQL}, feat AS (SELECT * FROM notes), {WIN_SQL} SELECT map_id, k, start_ms, end_ms, line_no FROM rows_")
def window_assignment(spark, sf):
    n = notes(spark, sf)
    return B.assign(n.drop("k"), B.map_bounds(n)).select("map_id", "k", "start_ms", "end_ms", "line_no")


AGG_SQL = f"""WITH {FEAT_SQL}, {WIN_SQL},
i AS (SELECT *, CASE WHEN speed IS NOT NULL THEN count(speed) OVER (PARTITION BY map_id, k ORDER BY t_ms, line_no) - 1 END AS i FROM rows_),
g AS (SELECT map_id, k, start_ms, end_ms, count(*) AS n_obj, avg(dt_prev) AS dt_mean, avg(dist_prev) AS dist_mean, avg(angle) AS angle_mean, avg(speed) AS speed_mean, max(speed) AS speed_max,
  avg(dist_center) AS center_mean, avg((obj_type = 'slider')::INT::DOUBLE) AS pct_slider, count(bearing) AS nb, avg(cos(radians(bearing))) AS c, avg(sin(radians(bearing))) AS s,
  CASE WHEN count(speed) >= 3 THEN regr_slope(speed, i) END AS slope FROM i GROUP BY map_id, k, start_ms, end_ms),
h AS (SELECT *, CASE WHEN dt_mean < 3600000 * 8 THEN 0 WHEN dist_mean > 200 THEN 1 ELSE 2 END AS dominant FROM g)"""


def _agg(spark, sf):
    return B.aggregates(assigned(spark, sf), stream_below=8.0 * HOUR)


@query("window_aggregates", f"""{AGG_SQL} SELECT map_id, start_ms, end_ms, n_obj, {r('dt_mean', 3)} AS dt_prev_mean, {r('dist_mean')} AS dist_prev_mean, {r('angle_mean', 4)} AS angle_mean, {r('speed_mean', 4)} AS speed_mean,
 {r('speed_max', 4)} AS speed_max, {r('center_mean')} AS dist_center_mean, {r('pct_slider')} AS pct_slider, {r('CASE WHEN nb >= 2 THEN 1 - sqrt(c * c + s * s) END')} AS bearing_var,
 {r('CASE WHEN speed_mean >= 0 THEN ln(1 + speed_mean) END', 5)} AS log_speed_mean FROM h""")
def window_aggregates(spark, sf):
    """The flagship: events to windows of varying length, with kinematic means."""
    g = _agg(spark, sf)
    return g.select("map_id", "start_ms", "end_ms", "n_obj", R(F.col("dt_prev_mean"), 3).alias("dt_prev_mean"), R(F.col("dist_prev_mean")).alias("dist_prev_mean"), R(F.col("angle_mean"), 4).alias("angle_mean"),
                    R(F.col("speed_mean"), 4).alias("speed_mean"), R(F.col("speed_max"), 4).alias("speed_max"), R(F.col("dist_center_mean")).alias("dist_center_mean"), R(F.col("pct_slider")).alias("pct_slider"),
                    R(F.col("bearing_var")).alias("bearing_var"), R(F.col("log_speed_mean"), 5).alias("log_speed_mean"))


@query("window_slope", f"{AGG_SQL} SELECT map_id, k, {r('slope', 3)} AS intensity_slope FROM h")
def window_slope(spark, sf):
    return _agg(spark, sf).select("map_id", "k", R(F.col("intensity_slope"), 3).alias("intensity_slope"))


@query("window_transitions", f"""{AGG_SQL} SELECT map_id, k, {r('speed_mean - lag(speed_mean) OVER w', 4)} AS speed_delta, n_obj - lag(n_obj) OVER w AS density_delta,
 coalesce((dominant <> lag(dominant) OVER w)::INT, 0) AS pattern_switch FROM h WINDOW w AS (PARTITION BY map_id ORDER BY start_ms, k)""")
def window_transitions(spark, sf):
    return _agg(spark, sf).select("map_id", "k", R(F.col("speed_delta"), 4).alias("speed_delta"), "density_delta", "pattern_switch")


STATS = ("dt_prev", "dist_prev", "angle", "speed", "dist_center", "x", "y")


@query("window_feature_stats", f"""WITH {FEAT_SQL}, {WIN_SQL}, u AS ({' UNION ALL '.join(f"SELECT map_id, k, '{c}' AS feature, {c}::DOUBLE AS v FROM rows_" for c in STATS)}),
g AS (SELECT map_id, k, feature, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi, median(v) AS md FROM u GROUP BY ALL),
e AS (SELECT win.map_id, win.k, f.feature FROM win, (SELECT unnest({list(STATS)}) AS feature) f)
SELECT e.map_id, e.k, e.feature, {', '.join(f"{r(f'CASE WHEN {a} IS NOT NULL THEN least(greatest({a}, -1e6), 1e6) END', 3)} AS {b}" for a, b in (('m', 'mean'), ('s', 'std'), ('lo', 'min'), ('hi', 'max'), ('md', 'median')))}
FROM e LEFT JOIN g ON e.map_id = g.map_id AND e.k = g.k AND e.feature = g.feature""")
def window_feature_stats(spark, sf):
    d = B.feature_stats(assigned(spark, sf), B.beat_windows(B.map_bounds(notes(spark, sf))), STATS)
    return d.select("map_id", "k", "feature", *[R(F.col(c), 3).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("window_feature_table", f"""WITH {FEAT_SQL}, {WIN_SQL} SELECT win.map_id, win.k, {', '.join(f"{r(f'CASE WHEN {f}({c}) IS NOT NULL THEN least(greatest({f}({c}), -1e6), 1e6) END', 3)} AS ts_{c}_{s}" for c in ('dist_prev', 'x') for f, s in (('avg', 'mean'), ('stddev_pop', 'std'), ('min', 'min'), ('max', 'max'), ('median', 'median')))}
FROM win LEFT JOIN rows_ q ON win.map_id = q.map_id AND win.k = q.k GROUP BY win.map_id, win.k""")
def window_feature_table(spark, sf):
    cols = ("dist_prev", "x")
    t = B.feature_table(B.feature_stats(assigned(spark, sf), B.beat_windows(B.map_bounds(notes(spark, sf))), cols), cols)
    return t.select("map_id", "k", *[R(F.col(c), 3).alias(c) for c in t.columns[2:]])


@query("window_type_fractions", f"""WITH {NOTES_SQL}, feat AS (SELECT *, ['L', 'B', 'C', 'P', 'X'][k % 5 + 1] AS curve FROM notes), {WIN_SQL},
g AS (SELECT map_id, k, {', '.join(f"avg((obj_type = '{t}')::INT::DOUBLE) AS {t}" for t in ('circle', 'slider', 'spinner'))},
 {', '.join(f"count(*) FILTER (obj_type = 'slider' AND curve = '{c}') / greatest(1, count(*) FILTER (obj_type = 'slider'))::DOUBLE AS c{c}" for c in 'LBCP')} FROM rows_ GROUP BY map_id, k)
SELECT map_id, k, {r('circle')} AS frac_circle, {r('slider')} AS frac_slider, {r('spinner')} AS frac_spinner, {', '.join(f"{r('c' + c)} AS curve_{c}" for c in 'LBCP')},
 {r(' + '.join(f"CASE WHEN c{c} > 0 THEN -c{c} * log2(c{c}) ELSE 0 END" for c in 'LBCP'))} AS curve_entropy FROM g""")
def window_type_fractions(spark, sf):
    n = notes(spark, sf)
    curve = F.element_at(F.array(*[F.lit(c) for c in "LBCPX"]), (F.col("k") % 5 + 1).cast("int"))
    d = B.type_fractions(B.assign(n.withColumn("curve", curve).drop("k"), B.map_bounds(n)))
    return d.select("map_id", "k", *[R(F.col(c)).alias(c) for c in d.columns[2:]])


@query("circular_stats", f"""WITH {FEAT_SQL}, {WIN_SQL}, g AS (SELECT map_id, k, count(bearing) AS n, avg(cos(radians(bearing))) AS c, avg(sin(radians(bearing))) AS s FROM rows_ WHERE obj_type = 'slider' GROUP BY map_id, k)
SELECT map_id, k, {r('CASE WHEN n >= 2 THEN least(greatest(1 - sqrt(c * c + s * s), 0e0), 1e0) WHEN n = 1 THEN 0 END')} AS circ_var, {r('CASE WHEN n >= 1 THEN (degrees(atan2(s, c)) % 360 + 360) % 360 END', 4)} AS circ_mean FROM g""")
def circular_stats(spark, sf):
    d = B.circular_stats(assigned(spark, sf).filter("obj_type = 'slider'"), "bearing")
    return d.select("map_id", "k", R(F.col("circ_var")).alias("circ_var"), R(F.col("circ_mean"), 4).alias("circ_mean"))


SPANS_SQL = "spans AS (SELECT map_id, t_ms AS a, t_ms + 6 * 3600000 AS b, event_type || (k % 5)::VARCHAR AS label FROM notes WHERE event_type = 'error')"
LABELS_SQL = f"""WITH {NOTES_SQL}, feat AS (SELECT * FROM notes), {WIN_SQL.split('rows_ AS')[0].rstrip().rstrip(',')}, {SPANS_SQL},
lab AS (SELECT w.map_id, w.k, coalesce(list_sort(list_distinct(list(s.label) FILTER (s.label IS NOT NULL))), []) AS labels FROM win w LEFT JOIN spans s ON w.map_id = s.map_id AND w.start_ms < s.b AND w.end_ms > s.a GROUP BY w.map_id, w.k)"""


def _labelled(spark, sf):
    n = notes(spark, sf)
    spans = n.filter("event_type = 'error'").select("map_id", F.col("t_ms").alias("a"), (F.col("t_ms") + 6 * HOUR).alias("b"), F.concat("event_type", (F.col("k") % 5).cast("string")).alias("label"))
    return B.overlap_labels(B.beat_windows(B.map_bounds(n)), spans)


@query("span_overlap_labels", f"{LABELS_SQL} SELECT map_id, k, array_to_string(labels, ',') AS labels FROM lab")
def span_overlap_labels(spark, sf):
    return _labelled(spark, sf).select("map_id", "k", F.array_join("labels", ",").alias("labels"))


@query("tag_multihot", f"""{LABELS_SQL}, t AS (SELECT tag FROM (SELECT unnest(labels) AS tag FROM lab) GROUP BY tag HAVING count(*) >= 5) SELECT map_id, k, tag, list_contains(labels, tag)::INT AS hot FROM lab, t""")
def tag_multihot(spark, sf):
    return B.multi_hot(_labelled(spark, sf))[1]


@query("attention_pool", f"WITH {NOTES_SQL}, m AS (SELECT *, k / 25e0 AS s, max(k / 25e0) OVER (PARTITION BY map_id) AS m FROM notes) SELECT map_id, {r('sum(exp(s - m) * x) / sum(exp(s - m))', 5)} AS pooled FROM m GROUP BY map_id")
def attention_pool(spark, sf):
    return B.attention_pool(notes(spark, sf), F.col("k") / 25.0, F.col("x")).select("map_id", R(F.col("pooled"), 5).alias("pooled"))


@query("map_stats", f"""WITH {SLIDERS_SQL}, {'f0 AS' + FEAT_SQL.split(', f0 AS', 1)[1]},
sp AS (SELECT map_id, min(angle) AS lo, max(angle) AS hi, count(angle) AS n FROM feat GROUP BY map_id),
eb AS (SELECT feat.map_id, n, CASE WHEN hi > lo THEN least(floor((angle - lo) / (hi - lo) * 36), 35) ELSE 0 END AS b, count(*) AS c FROM feat JOIN sp ON feat.map_id = sp.map_id WHERE angle IS NOT NULL GROUP BY ALL),
e AS (SELECT map_id, CASE WHEN any_value(n) >= 2 THEN sum(-(c / n::DOUBLE) * ln(c / n::DOUBLE)) END AS h FROM eb GROUP BY map_id),
cells AS (SELECT map_id, least(floor(x / 512 * 8), 7) AS bx, least(floor(y / 384 * 6), 5) AS by_, count(*) AS c FROM notes GROUP BY ALL),
sh AS (SELECT map_id, CASE WHEN sum(c) >= 4 THEN ln(sum(c)) - sum(c * ln(c)) / sum(c) END AS h FROM cells GROUP BY map_id),
g AS (SELECT map_id, count(*) AS note_count, count(*) FILTER (obj_type = 'circle') AS count_circles, count(*) FILTER (obj_type = 'slider') AS count_sliders, count(*) FILTER (obj_type = 'spinner') AS count_spinners,
 quantile_cont(speed, 0.95) AS p95, avg((dt_prev < 28800000)::INT::DOUBLE) AS sf, avg((dist_prev > 200)::INT::DOUBLE) AS jf FROM feat GROUP BY map_id),
sc AS (SELECT map_id, avg(1 - curvature) AS c FROM s GROUP BY map_id),
bv AS (SELECT map_id, CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(60 + k::DOUBLE) END AS v FROM notes WHERE event_type = 'signup' GROUP BY map_id)
SELECT g.map_id, note_count, count_circles, count_sliders, count_spinners, {r('p95', 3)} AS speed_p95, {r('sf')} AS stream_fraction, {r('jf')} AS jump_fraction, {r('sc.c')} AS slider_complexity, {r('e.h', 4)} AS angle_entropy, {r('sh.h')} AS spatial_entropy, {r('v', 4)} AS bpm_variance
FROM g LEFT JOIN e USING (map_id) LEFT JOIN sh USING (map_id) LEFT JOIN sc USING (map_id) LEFT JOIN bv USING (map_id)""")
def map_stats(spark, sf):
    f = features(spark, sf)
    shape = N.slider_shape(slider_notes(spark, sf)).select("map_id", "line_no", "curvature")
    timing = notes(spark, sf).filter("event_type = 'signup'").select("map_id", (60 + F.col("k").cast("double")).alias("value"))
    out = G.summary(f.join(shape, ["map_id", "line_no"]), stream_below=8.0 * HOUR)
    for more in (G.histogram_entropy(f, "angle", 36, "angle_entropy"), G.spatial_entropy(f), G.value_variance(timing)):
        out = out.join(more, "map_id", "left")
    digits = {"speed_p95": 3, "angle_entropy": 4, "bpm_variance": 4}
    return out.select(*out.columns[:5], *[R(F.col(c), digits.get(c, 6)).alias(c) for c in out.columns[5:]])
