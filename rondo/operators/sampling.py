"""Seeded samples that any run repeats: rows are ordered by a hash of their key and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    """Fifteen hex digits of md5: the same order in any engine. Ties by the key itself."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 15)


def exact_sample(rows: DataFrame, key: str, n: int, seed: int = 2025) -> DataFrame:
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def capped_groups(rows: DataFrame, group: str, key: str, n: int = 64, seed: int = 2025) -> DataFrame:
    """At most n rows of each group."""
    w = W.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def lod_levels(rows: DataFrame, key: str, sizes: tuple[int, ...], seed: int = 2025) -> DataFrame:
    """lod: the first (smallest) nested sample that holds a row; rows beyond the largest sample go."""
    top = rows.orderBy(hash_order(F.col(key), seed), key).limit(max(sizes))
    # The window sees at most max(sizes) rows.
    n = F.row_number().over(W.orderBy(hash_order(F.col(key), seed), key))
    level = F.when(n <= sizes[0], 0)
    for k, s in enumerate(sizes[1:], 1):
        level = level.when(n <= s, k)
    return top.withColumn("lod", level)


def batches(rows: DataFrame, key: str, size: int = 50) -> DataFrame:
    """Batch number of each row in key order, within ranges of the key so that no task numbers all rows."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(F.floor(F.col(key) / (size * 1000))).orderBy(key)) - 1) / size))


#: Rows that are sampled for the bounds of numeric_order, and parts that they make.
BOUNDS_FROM, PARTS = 20_000, 64


def numeric_order(ids: DataFrame, key: str) -> DataFrame:
    """(pos, key): position of all ids, whole numbers first and by value, then the others as text.

    Bounds from a sample deal the ids into ranges; the ranges' row counts give offsets, so no task sees all ids.
    """
    number = F.col(key).try_cast("bigint")
    order = F.struct(number.isNull().alias("text"), F.coalesce(number, F.lit(0)).alias("number"), F.col(key).alias("id"))
    rows = ids.select(F.col(key), order.alias("__o"))
    n = rows.count()
    some = rows if n <= BOUNDS_FROM else rows.sample(BOUNDS_FROM / n, seed=7)
    got = sorted({(r["text"], r["number"], r["id"]) for r in some.select("__o.*").filter("id is not null").collect()})
    cuts = sorted({got[k * len(got) // PARTS] for k in range(1, PARTS)}) if got else []
    at = [F.struct(F.lit(t).alias("text"), F.lit(x).cast("bigint").alias("number"), F.lit(i).alias("id")) for t, x, i in cuts]
    part = F.size(F.filter(F.array(*at), lambda c: c <= F.col("__o"))) if at else F.lit(0)
    dealt = rows.withColumn("__p", part)
    sizes = {r["__p"]: r["count"] for r in dealt.groupBy("__p").count().collect()}  # one row a range
    base = [sum(c for q, c in sizes.items() if q < k) for k in range(len(cuts) + 1)]
    inside = F.row_number().over(W.partitionBy("__p").orderBy("__o"))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in base]), F.col("__p") + 1)
    return dealt.select((offset + inside).alias("pos"), key)
