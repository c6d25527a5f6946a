"""The driver's tables in the roles that the operators read, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import table

HOUR = 3_600_000

NOTES_SQL = """notes AS (SELECT user_id AS map_id, event_id AS line_no, epoch_us(ts) // 1000 AS t_ms, least(value, 512e0) AS x,
  json_extract(props, '$.k')::DOUBLE * 384e0 / 99e0 AS y, json_extract(props, '$.k')::BIGINT AS k, event_type,
  CASE event_type WHEN 'purchase' THEN 'slider' WHEN 'error' THEN 'spinner' ELSE 'circle' END AS obj_type,
  (3600000 * (3 + user_id % 4))::DOUBLE AS beat_ms, 3600000 * (6 + user_id % 12) AS preempt_ms FROM events)"""

DELTAS_SQL = NOTES_SQL + """,
d AS (SELECT *, row_number() OVER w - 1 AS obj_idx, t_ms - lag(t_ms) OVER w AS dt_prev,
  sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS dist_prev
  FROM notes WINDOW w AS (PARTITION BY map_id ORDER BY t_ms, line_no))"""


def notes(spark, sf_dir) -> DataFrame:
    """Events as notes: user = map, value = x, k = y."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("map_id"), F.col("event_id").alias("line_no"),
        F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t_ms"),
        F.least("value", F.lit(512.0)).alias("x"), (k.cast("double") * 384.0 / 99.0).alias("y"), k.alias("k"), "event_type",
        F.when(F.col("event_type") == "purchase", "slider").when(F.col("event_type") == "error", "spinner").otherwise("circle").alias("obj_type"),
        (HOUR * (3 + F.col("user_id") % 4)).cast("double").alias("beat_ms"),
        (HOUR * (6 + F.col("user_id") % 12)).alias("preempt_ms"),
    )


SLIDERS_SQL = NOTES_SQL + """,
s0 AS (SELECT *, CASE WHEN obj_type = 'slider' THEN x END AS slider_len, (1 + k % 3) AS slider_repeats, (k % 5) AS slider_anchors,
  x + (k % 7) - 3 AS fa_x, y + (k % 3) - 1 AS fa_y, CASE WHEN k % 4 > 0 THEN 512e0 - x END AS la_x, CASE WHEN k % 4 > 0 THEN 384e0 - y END AS la_y FROM notes),
s1 AS (SELECT *, CASE WHEN obj_type = 'slider' THEN slider_len / (100 * 1.4e0 * greatest(1e-6, 1e0)) * (beat_ms / 16) * greatest(1, slider_repeats) END AS slider_dur FROM s0),
s AS (SELECT *, slider_len / greatest(1e0, slider_dur) AS slider_vel, slider_anchors / greatest(1e0, slider_dur) * 1000 AS anchor_density,
  CASE WHEN obj_type = 'slider' AND (abs(fa_x - x) > 5e-1 OR abs(fa_y - y) > 5e-1) THEN (degrees(atan2(fa_y - y, fa_x - x)) % 360 + 360) % 360 END AS slider_dir,
  CASE WHEN obj_type = 'slider' AND la_x IS NOT NULL THEN least(1e0, sqrt((la_x - x) * (la_x - x) + (la_y - y) * (la_y - y)) / greatest(1e0, slider_len)) END AS curvature,
  CASE WHEN obj_type = 'slider' THEN CASE WHEN slider_repeats % 2 = 1 AND la_x IS NOT NULL THEN la_x ELSE x END END AS slider_end_x,
  CASE WHEN obj_type = 'slider' THEN CASE WHEN slider_repeats % 2 = 1 AND la_x IS NOT NULL THEN la_y ELSE y END END AS slider_end_y FROM s1)"""


def slider_notes(spark, sf_dir) -> DataFrame:
    """Notes with the raw slider columns; the beat is a sixteenth so that sliders end before the next note."""
    k = F.col("k")
    return notes(spark, sf_dir).withColumns({
        "slider_len": F.when(F.col("obj_type") == "slider", F.col("x")), "slider_repeats": 1 + k % 3, "slider_anchors": k % 5, "sv": F.lit(1.0),
        "fa_x": F.col("x") + k % 7 - 3, "fa_y": F.col("y") + k % 3 - 1,
        "la_x": F.when(k % 4 > 0, 512.0 - F.col("x")), "la_y": F.when(k % 4 > 0, 384.0 - F.col("y")), "beat_ms": F.col("beat_ms") / 16,
    })


def r(sql: str, digits: int = 6) -> str:
    """SQL of scalars.rounded."""
    return f"floor(({sql}) * 1e{digits} + 5e-1) / 1e{digits}"
