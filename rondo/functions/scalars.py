"""Scalar column functions: missing values, rounding, geometry, text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the playfield and of rating status.
WIDTH, HEIGHT, HALF_DIAGONAL, DIAGONAL = 512.0, 384.0, 320.0, 640.0
RANKED = ("ranked", "approved", "qualified")


def finite(c: Column) -> Column:
    """NaN and infinities are missing."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def rounded(c: Column, digits: int = 6) -> Column:
    """Round half up by floor: every engine gives the same last digit.

    Spark's floor ends at the largest long; from 2^52 on a double is whole and stays as it is.
    """
    k = 10.0**digits
    v = c * k + 0.5
    return F.when(F.abs(v) < 2.0**52, F.floor(v)).otherwise(v) / k


def bankers(c: Column, digits: int) -> Column:
    """Round half to even, for exports."""
    return F.bround(c, digits)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Missing stays missing (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def length2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def bearing(dx: Column, dy: Column) -> Column:
    """Direction in degrees, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def turn(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Turning angle from one step to the next in degrees, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dy2, dx2) - F.atan2(dy1, dx1)), F.lit(360.0))


def jump_type(angle: Column) -> Column:
    """-1 without context, 0 straight on, 1 turn back, 2 sideways, 3 between."""
    return (
        F.when(angle.isNull(), -1).when((angle < 30) | (angle > 330), 0).when(angle.between(150, 210), 1)
        .when(angle.between(50, 130), 2).otherwise(3)
    )


def quadrant(x: Column, y: Column) -> Column:
    return (x >= WIDTH / 2).cast("int") + 2 * (y >= HEIGHT / 2).cast("int")


def edge_proximity(x: Column, y: Column) -> Column:
    return F.least(x, WIDTH - x, F.greatest(F.lit(0.0), y), HEIGHT - y) / (HEIGHT / 2)


def center_distance(x: Column, y: Column) -> Column:
    return length2(x - WIDTH / 2, y - HEIGHT / 2)


def log1p_positive(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def preempt_ms(ar: Column) -> Column:
    """How long a note shows before it is due, by approach rate (default 5)."""
    a = F.coalesce(ar, F.lit(5.0))
    return clamp(F.when(a < 5, 1200 + 120 * (5 - a)).otherwise(1200 - 150 * (a - 5)), 300.0, 1800.0)


def slider_duration(length: Column, multiplier: Column, sv: Column, beat_ms: Column, repeats: Column) -> Column:
    m = F.coalesce(multiplier, F.lit(1.4))
    return length / (100 * m * F.greatest(F.lit(1e-6), sv)) * beat_ms * F.greatest(F.lit(1), F.coalesce(repeats, F.lit(1)))


def percent_drop(before: Column, now: Column) -> Column:
    return F.when(before > 0, (before - now) / before).otherwise(F.lit(0.0))


def safe_int(s: Column) -> Column:
    """Text to a whole number, decimals cut off; null if it isn't a number."""
    return s.try_cast("double").cast("bigint")


def ranked_flag(status: Column) -> Column:
    return F.lower(F.trim(status)).isin(*RANKED).cast("double")


def normal_id(s: Column) -> Column:
    """Ids without blanks, byte-order mark, quotes or a trailing .0; digits keep their leading zeros."""
    t = F.regexp_replace(F.trim(F.regexp_replace(s, "﻿", "")), "^[\"']+|[\"']+$", "")
    return F.when(t.rlike("^[0-9]+$"), t).otherwise(F.coalesce(t.try_cast("double").cast("bigint").cast("string"), t))


def unit(v: Column, eps: float = 1e-9) -> Column:
    """A vector scaled to length one."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / (n + eps))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def lat_lon(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.asin(clamp(z, -1.0, 1.0)), F.atan2(y, x)


def hover_text(artist: Column, title: Column, version: Column, map_id: Column) -> Column:
    """Artist - title [version], with what is there, else the id."""
    some = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    song = F.concat_ws(" - ", some(artist), some(title))
    full = F.when(some(version).isNotNull() & (F.length(song) > 0), F.concat(song, F.lit(" ["), some(version), F.lit("]"))).otherwise(song)
    return F.coalesce(F.when(F.length(full) > 0, full), some(version), map_id.cast("string"))
