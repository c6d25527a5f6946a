"""Sharding by global byte-size prefix sums (operator 10), DataFrame functions only.

Method: rows are range-partitioned by (md5 of the text, doc_id), so equal texts lie side by side; the totals of the
partitions give each partition its offset; offset plus the running sum inside the partition is the global prefix
sum, which is cut at equal byte targets. Only (doc_id, size, two hashes) are shuffled, never the text, and the range
partitioner splits a group of copies by doc_id, so no partition holds a hot group whole.

Edge cases: a null text counts 1 byte and has the CRC of the empty text; null doc_ids come first; repeated rows each
take a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release

#: A cut inside a group of equal texts moves to the nearer end of the group if that takes under 1/SNAP of a shard.
SNAP = 100


def prefix_sums(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, size, text_crc32, h, start, rn): global exclusive byte prefix sum and row number in shard order."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(body.cast("binary"))).alias("h"),
    )
    # Rows that are equal in all that orders them, as repeated rows without doc_id, are parted by where they were read.
    narrow = narrow.withColumn("salt", F.monotonically_increasing_id())
    order = ["h", "doc_id", "size", "salt"]
    ranged = materialize(
        narrow.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "shard-ranged"
    )
    parts = ranged.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "pid",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"),
    )
    inside = W.partitionBy("pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = ranged.select(
        "*", F.sum("size").over(inside).alias("upto"), F.row_number().over(inside).alias("nth")
    )
    out = running.join(offsets, "pid").select(
        "doc_id", "size", "text_crc32", "h",
        (F.col("base") + F.col("upto") - F.col("size")).alias("start"),
        (F.col("base_rows") + F.col("nth") - 1).alias("rn"),
    )
    placed = materialize(out, "shard-placed")
    release(ranged)
    return placed


def byte_cuts(placed: DataFrame, n_shards: int) -> list[int]:
    """The n_shards - 1 prefix sums at which a new shard begins. Only these few numbers reach the driver."""
    total = placed.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
    ideal = [-(-total * k // n_shards) for k in range(1, n_shards)]
    if not total or not ideal:
        return ideal
    cuts = F.explode(F.array(*[F.lit(c).cast("long") for c in sorted(set(ideal))])).alias("cut")
    # At most one row straddles each cut, so `torn` has under n_shards rows.
    torn = placed.filter(
        F.floor(F.col("start") * n_shards / total) != F.floor((F.col("start") + F.col("size")) * n_shards / total)
    ).select("h").distinct()
    groups = (
        placed.join(F.broadcast(torn), "h", "left_semi")
        .groupBy("h").agg(F.min("start").alias("a"), F.sum("size").alias("n"))
        .select("a", "n", cuts).filter("cut > a and cut < a + n").collect()
    )
    at = {g["cut"]: g for g in groups}

    def snapped(c: int) -> int:
        g = at.get(c)
        if g is None or g["n"] * SNAP * n_shards > total:
            return c
        return g["a"] if c - g["a"] <= g["a"] + g["n"] - c else g["a"] + g["n"]

    return [snapped(c) for c in ideal]


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Contiguous shards of near-equal bytes: (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    placed = prefix_sums(docs, text, key)
    cuts = byte_cuts(placed, n_shards)
    starts = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    sharded = placed.withColumn("shard", F.size(F.filter(starts, lambda c: c <= F.col("start"))))
    first = {r["shard"]: r["rn"] for r in sharded.groupBy("shard").agg(F.min("rn").alias("rn")).collect()}
    base = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rn") - F.element_at(base, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
