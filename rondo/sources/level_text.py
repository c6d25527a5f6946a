"""Level text files: sections, key-value pairs, timing lines and hit-object lines, all in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import safe_int

HEADER = "osu file format"
DIFFICULTY = ("HPDrainRate", "CircleSize", "OverallDifficulty", "ApproachRate", "SliderMultiplier", "SliderTickRate")


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, text) of a folder of level files; the id is the file's name. Byte-order marks go; files without header too."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("map_id"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return t.filter(F.ltrim("text").startswith(HEADER))


def sections(levels: DataFrame) -> DataFrame:
    """(map_id, section, line_no, line): non-blank lines under a [Section] header."""
    lines = levels.select("map_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "raw")).withColumn("line", F.trim("raw"))
    head = F.regexp_extract("line", r"^\[(.+?)\]\s*$", 1)
    w = W.partitionBy("map_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    s = lines.withColumn("head", F.when(head != "", head)).withColumn("section", F.last("head", ignorenulls=True).over(w))
    return s.filter("section is not null and head is null and line <> ''").select("map_id", "section", "line_no", "line")


def key_values(rows: DataFrame, section: str) -> DataFrame:
    """(map_id, key, value): split at the first colon; of equal keys the last."""
    s = rows.filter((F.col("section") == section) & F.col("line").contains(":"))
    p = F.split("line", ":", 2)
    return s.groupBy("map_id", F.trim(p[0]).alias("key")).agg(F.max_by(F.trim(p[1]), F.col("line_no")).alias("value"))


def difficulty(rows: DataFrame) -> DataFrame:
    """One row per map of the known difficulty numbers; what isn't a number is null."""
    kv = key_values(rows, "Difficulty").withColumn("v", F.col("value").try_cast("double"))
    return kv.groupBy("map_id").pivot("key", list(DIFFICULTY)).agg(F.first("v"))


def timing(rows: DataFrame) -> DataFrame:
    """(map_id, line_no, t_ms, kind, value): bpm of uninherited lines, speed factor of inherited ones."""
    p = F.split("line", ",")
    t, length = F.trim(p[0]).try_cast("double"), F.trim(F.get(p, F.lit(1))).try_cast("double")
    un = F.coalesce(safe_int(F.trim(F.get(p, F.lit(6)))), F.lit(1))
    value = F.when((un == 1) & (length > 0), 60000.0 / length).when((un == 0) & (length < 0), -100.0 / length)
    kind = F.when(un == 1, "bpm").otherwise("sv")
    out = rows.filter("section = 'TimingPoints'").select("map_id", "line_no", t.cast("bigint").alias("t_ms"), kind.alias("kind"), value.alias("value"))
    return out.filter("t_ms is not null and value is not null")


def hit_objects(rows: DataFrame, max_ms: int = 3_600_000) -> DataFrame:
    """Typed hit objects: circle, slider (curve, repeats, length, anchors) or spinner; times out of range go."""
    p = F.split("line", ",")
    kind = safe_int(F.trim(p[3]))
    obj = F.when(kind.bitwiseAND(F.lit(2)) != 0, "slider").when(kind.bitwiseAND(F.lit(8)) != 0, "spinner").otherwise("circle")
    s = rows.filter("section = 'HitObjects'").filter(F.size(p) >= 4).select(
        "map_id", "line_no", safe_int(F.trim(p[2])).alias("t_ms"), F.trim(p[0]).try_cast("double").alias("x"), F.trim(p[1]).try_cast("double").alias("y"), obj.alias("obj_type"),
        F.split(F.get(p, F.lit(5)), r"\|").alias("path"), safe_int(F.get(p, F.lit(6))).alias("repeats"), F.trim(F.get(p, F.lit(7))).try_cast("double").alias("len"))
    s = s.filter(F.col("t_ms").between(0, max_ms) & F.col("x").isNotNull() & F.col("y").isNotNull())
    slider = F.col("obj_type") == "slider"
    anchors = F.filter("path", lambda a: F.contains(a, F.lit(":")))
    xy = lambda a, i: F.split(a, ":")[i].try_cast("double")
    first, last = F.get("anchors", F.lit(0)), F.get("anchors", F.size("anchors") - 1)
    s = s.withColumn("anchors", F.when(slider, anchors))
    return s.select(
        "map_id", "line_no", "t_ms", "x", "y", "obj_type", F.when(slider, F.get("path", F.lit(0))).alias("curve"), F.when(slider, F.greatest(F.lit(1), F.coalesce("repeats", F.lit(1)))).alias("slider_repeats"),
        F.when(slider, F.col("len")).alias("slider_len"), F.when(slider, F.size("anchors")).alias("slider_anchors"),
        xy(first, 0).alias("fa_x"), xy(first, 1).alias("fa_y"), xy(last, 0).alias("la_x"), xy(last, 1).alias("la_y"))


def skip_reason(levels: DataFrame) -> DataFrame:
    """(map_id, reason): why a level isn't processed, or OK."""
    rows = sections(levels)
    mode = key_values(rows, "General").filter("key = 'Mode'").select("map_id", safe_int(F.col("value")).alias("mode"))
    n = rows.filter("section = 'HitObjects'").groupBy("map_id").agg(F.count("*").alias("n"))
    good = hit_objects(rows).groupBy("map_id").agg(F.count("*").alias("good"))
    j = levels.select("map_id").join(mode, "map_id", "left").join(n, "map_id", "left").join(good, "map_id", "left")
    r = F.when(F.coalesce("mode", F.lit(0)) != 0, "NON_STD_MODE").when(F.col("n").isNull(), "NO_HITOBJECTS").when(F.col("good").isNull(), "NO_VALID_HITOBJECTS").otherwise("OK")
    return j.select("map_id", r.alias("reason"))


def id_list(c: Column) -> Column:
    """Whole numbers of a text that lists ids by commas or blanks; anything else is left out."""
    return F.filter(F.transform(F.split(c, "[ ,]+"), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
