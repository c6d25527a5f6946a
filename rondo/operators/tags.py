"""Explaining clusters by tags, and robust statistics per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def enrichment(members: DataFrame, tags: DataFrame, top_k: int = 10) -> DataFrame:
    """Per cluster its top_k tags by count, with log enrichment against all tagged maps.

    members: (map_id, cluster); tags: distinct (map_id, tag). Only maps with a tag count. Ties go to the lesser tag.
    """
    t = members.join(tags, "map_id")
    counts = t.groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    sizes = t.groupBy("cluster").agg(F.count_distinct("map_id").alias("size"))
    glob = counts.groupBy("tag").agg(F.sum("n").alias("n_all"))
    total = t.agg(F.count_distinct("map_id").alias("total"))
    j = counts.join(sizes, "cluster").join(glob, "tag").crossJoin(F.broadcast(total))  # one row
    frac, frac_all = F.col("n") / F.col("size"), F.col("n_all") / F.col("total")
    ranked = j.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "tag"))).filter(F.col("rank") <= top_k)
    return ranked.select("cluster", F.col("size").alias("tagged"), "tag", F.col("n").alias("tag_count"), frac.alias("frac"), frac_all.alias("frac_all"), F.ln((frac + 1e-9) / (frac_all + 1e-9)).alias("enrichment"))


def best_tags(enriched: DataFrame, k: int = 1) -> DataFrame:
    """The k most enriched tags of each cluster as one label."""
    w = W.partitionBy("cluster").orderBy(F.desc("enrichment"), F.desc("tag_count"), "tag")
    top = enriched.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ", ").alias("label"))


def display_names(weighted: DataFrame, limits: dict[str, int]) -> DataFrame:
    """c{cluster}: then the top names of each category, by weight, joined; a dash where there is none.

    weighted: (cluster, category, name, weight). limits: names shown of each category, in order.
    """
    sums = weighted.groupBy("cluster", "category", "name").agg(F.sum("weight").alias("w"))
    rank = F.row_number().over(W.partitionBy("cluster", "category").orderBy(F.desc("w"), F.lower("name"), "name"))
    top = sums.withColumn("rank", rank)
    parts = []
    for c, n in limits.items():
        mine = F.collect_list(F.when((F.col("category") == c) & (F.col("rank") <= n), F.struct("rank", "name")))
        parts.append(F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(mine), lambda x: x["name"]), " / "), F.lit("")), F.lit("-")))
    return top.groupBy("cluster").agg(F.concat(F.lit("c"), F.col("cluster").cast("string"), F.lit(": "), F.concat_ws(" | ", *parts)).alias("name"))


def trimmed_means(rows: DataFrame, cluster: str, value: str, sigma: float = 2.5) -> DataFrame:
    """Mean of the values within sigma deviations of the cluster's mean; the plain mean if they hardly vary. Null if none."""
    g = rows.groupBy(cluster).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))
    j = rows.select(cluster, value).join(g, cluster)
    keep = (F.col("sd") <= 1e-6) | (F.abs(F.col(value) - F.col("mu")) <= sigma * F.col("sd"))
    return j.groupBy(cluster).agg(F.avg(F.when(keep, F.col(value))).alias("trimmed"), F.count(F.when(keep, F.col(value))).alias("kept"))


def cluster_details(members: DataFrame, labelled: DataFrame, top: int | None = None) -> DataFrame:
    """Per cluster: maps, labelled maps, distinct tags, and the sorted list of labelled maps with their tags.

    members: (cluster, map_id); labelled: (map_id, tag).
    """
    by_map = labelled.groupBy("map_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    j = members.join(by_map, "map_id", "left")
    entry = F.when(F.col("tags").isNotNull(), F.struct(F.col("map_id").cast("string").alias("map_id"), "tags"))
    return j.groupBy("cluster").agg(
        F.count("*").alias("n_maps"), F.count("tags").alias("n_labeled"), F.size(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("n_tags"),
        F.array_sort(F.collect_list(entry)).alias("labeled_maps"),
    )


def auto_range(rows: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Percentile range; minimum and maximum if that is empty; one wide if these are equal. Also how many values there are."""
    at = quantiles(rows, [value], [lo, hi])
    g = rows.agg(F.lit(at[value, lo]).cast("double").alias("a"), F.lit(at[value, hi]).cast("double").alias("b"), F.min(value).alias("mn"), F.max(value).alias("mx"), F.count(value).alias("known"), F.count("*").alias("n"))
    a = F.when(F.col("b") > F.col("a"), F.col("a")).otherwise(F.col("mn"))
    b = F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("mx"))
    return g.select(a.alias("lo"), F.when(b > a, b).otherwise(a + 1).alias("hi"), "known", "n")


def clamped_range(rows: DataFrame, value: str, gap: float = 10.0) -> DataFrame:
    """2nd and 98th percentile, clipped to [30, 280] and [60, 300], at least `gap` apart."""
    at = quantiles(rows, [value], [0.02, 0.98])
    g = rows.sparkSession.createDataFrame([(at[value, 0.02], at[value, 0.98])], "a double, b double")
    lo, hi = F.least(F.greatest("a", F.lit(30.0)), F.lit(280.0)), F.least(F.greatest("b", F.lit(60.0)), F.lit(300.0))
    return g.select(lo.alias("lo"), F.greatest(hi, lo + gap).alias("hi"))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with equal keys; the rest of both stays."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["__seq"]).drop("__seq")
