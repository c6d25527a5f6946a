"""Exact quantiles of whole columns in bounded memory.

Each wanted rank has an interval that holds it. A pass counts the rows of each interval in BINS bins of equal width, with the
least and greatest value of each bin; the bin that the rank falls into is the next interval. An interval of one
value is the answer. Every pass is one aggregation that combines before its shuffle, and only bin counts reach the driver:
a few thousand rows whatever the data. Three or four passes do for a billion different values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite

BINS = 1024


def quantiles(rows: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float | None]:
    """The interpolated quantiles of each column, on the driver; null where a column has no finite value.

    Nulls, NaN and infinities are left out. Of n values sorted the quantile p lies at place p * (n - 1).
    """
    of = {c: finite(F.col(f"`{c}`").cast("double")) for c in columns}
    ends = rows.agg(*[f(of[c]).alias(f"{name}{k}") for k, c in enumerate(columns) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    places = {(c, p): p * (ends[f"n{k}"] - 1) for k, c in enumerate(columns) for p in probs if ends[f"n{k}"]}
    found: dict[tuple[str, int], float] = {}
    # Interval of each open rank: (column, rank) -> (lo, hi, rows below).
    open_ = {}
    for (c, _), at in places.items():
        k = columns.index(c)
        for rank in {math.floor(at), math.ceil(at)}:
            open_[c, rank] = (ends[f"lo{k}"], ends[f"hi{k}"], 0)
    while True:
        for key in [key for key, (lo, hi, _) in open_.items() if lo == hi]:
            found[key] = open_.pop(key)[0]
        if not open_:
            break
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        inside = F.array(*[F.when(of[c].between(lo, hi), F.struct(F.lit(i).alias("span"), of[c].alias("v"), _bin(of[c], lo, hi).alias("bin"))) for i, (c, lo, hi) in enumerate(spans)])
        long = rows.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).select("x.*")
        bins: dict[int, list] = {}
        for r in long.groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("span", "bin").collect():
            bins.setdefault(r["span"], []).append(r)
        for key, (lo, hi, below) in list(open_.items()):
            for r in bins[spans.index((key[0], lo, hi))]:
                if below + r["n"] > key[1]:
                    open_[key] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in columns for p in probs}
    for (c, p), at in places.items():
        a, b = found[c, math.floor(at)], found[c, math.ceil(at)]
        out[c, p] = a + (b - a) * (at - math.floor(at))
    return out


def _bin(v, lo: float, hi: float):
    """Bin of a value between lo and hi; the greatest value has a bin of its own, so each pass parts what differs."""
    if math.isinf(hi - lo):  # ends of opposite sign near the largest number
        return F.when(v < 0, 0).otherwise(1)
    width = (hi - lo) / BINS
    if width <= 0:  # neighbouring numbers near zero
        return F.when(v <= lo, 0).otherwise(BINS)
    return F.when(v >= hi, BINS).otherwise(F.floor((v - lo) / width)).cast("int")
