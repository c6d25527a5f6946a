"""The viewer's files: points, labels, details, ids, hover texts, levels of detail, cluster statistics and a summary.

Tables that grow with the maps are written by the tasks, a JSON value a line in order of their position; what there is one row of
a cluster or a metric goes into small JSON files of the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, hover_text, ranked_flag
from ..operators.sampling import hash_order
from ..operators.tags import trimmed_means
from .files import write_json
from .sinks import PointsSource

METRICS = ("star", "hp", "od", "cs", "ar", "bpm", "length")
SCHEMA_2D = ("x", "y", "cluster", "is_labeled", "alpha", "star", "ranked", "hp", "od", "cs", "ar", "bpm", "length")
SCHEMA_3D = ("x", "y", "z", *SCHEMA_2D[2:])
LODS = {"low": 25_000, "mid": 100_000, "high": 250_000}
LEAST_LOW = 1000


def points_table(coords: DataFrame, meta: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row a map: position, coordinates, cluster, labelled or not, opacity, metrics and hover text.

    coords: (pos, map_id, x, y, z, cluster, alpha); meta: (map_id, status, artist, title, version, creator and METRICS);
    labelled: (map_id). Maps without metadata keep their row: unknown metrics are null, an unknown status is -1.
    """
    own = labelled.select(F.col("map_id").alias("id")).distinct().withColumn("yes", F.lit(1))
    j = coords.join(meta, "map_id", "left").join(own, F.col("map_id") == F.col("id"), "left")
    return j.select(
        "pos", "map_id", "x", "y", "z", "cluster", F.coalesce("yes", F.lit(0)).alias("is_labeled"), "alpha",
        F.when(F.trim("status") != "", ranked_flag(F.col("status")).cast("int")).otherwise(F.lit(None)).alias("known_rank"),
        *[finite(F.col(m).cast("double")).alias(m) for m in METRICS],
        hover_text(F.col("artist"), F.col("title"), F.col("version"), F.col("map_id")).alias("hover"), F.coalesce(F.trim("creator"), F.lit("")).alias("creator"),
    ).withColumn("ranked", F.coalesce("known_rank", F.lit(-1))).drop("known_rank")


def cluster_labels(points: DataFrame, names: DataFrame, radius: float = 1.0) -> DataFrame:
    """(cluster, text, n, x, y, sx, sy, sz): mean place of each cluster in the plane and on the sphere. A cluster without a name is c{number}."""
    g = points.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    on = lambda c: F.when(length > 1e-8, F.col(c) / length * radius).otherwise(F.col(c)).alias(f"s{c}")
    j = g.join(names, "cluster", "left")
    return j.select("cluster", F.coalesce("text", F.concat(F.lit("c"), F.col("cluster").cast("string"))).alias("text"), "n", "x", "y", *[on(c) for c in "xyz"])


def lod_of(points: DataFrame, sizes: dict[str, int] | None = None, seed: int = 2025) -> tuple[DataFrame, dict[str, int]]:
    """(lod, pos): nested seeded samples of positions, and their sizes; each is at least as large as the one before."""
    n, least, out, parts = points.count(), LEAST_LOW, {}, []
    ordered = points.select("pos").orderBy(hash_order(F.col("pos"), seed), "pos")
    for name, size in (sizes or LODS).items():
        least = min(n, max(least, size))
        out[name] = least
        parts.append(ordered.limit(least).select(F.lit(name).alias("lod"), "pos"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    return rows, out


def cluster_stats(points: DataFrame, sigma: float = 2.5) -> DataFrame:
    """(cluster, metric, trimmed, kept) of every metric."""
    out = None
    for m in METRICS:
        t = trimmed_means(points, "cluster", m, sigma).select("cluster", F.lit(m).alias("metric"), "trimmed", "kept")
        out = t if out is None else out.union(t)
    return out


def _lines(rows: DataFrame, value, path: str) -> None:
    """One JSON value a line, in order of position, which it names, over all files."""
    rows.select("pos", F.to_json(value, {"ignoreNullFields": "false"}).alias("value")).orderBy("pos").select("value").write.mode("overwrite").text(path)


def export_viewer(points: DataFrame, names: DataFrame, path: str, details: DataFrame | None = None, contours: dict | None = None, lods: dict[str, int] | None = None, radius: float = 1.0, said: dict | None = None) -> dict:
    """Write all files of the viewer below a path; returns the summary, which is meta.json.

    points: from points_table; names: (cluster, text); details: (cluster, ...), one row a cluster; contours: metric -> rows of
    segments as lists, bounded by the grid.
    """
    spark = points.sparkSession
    head = ("map_id", "cluster", "is_labeled", "alpha", "star", "ranked", "hp", "od", "cs", "ar", "bpm")
    _lines(points, F.struct("pos", "x", "y", *head), f"{path}/points.jsonl")
    _lines(points, F.struct("pos", "x", "y", "z", *head), f"{path}/points3d.jsonl")
    points.select("pos", "map_id").orderBy("pos").select("map_id").write.mode("overwrite").text(f"{path}/map_ids.txt")
    _lines(points, F.struct("pos", "hover", "creator"), f"{path}/map_hover.jsonl")
    labels = cluster_labels(points, names, radius).orderBy("cluster").collect()  # one row a cluster
    write_json(spark, f"{path}/labels.json", [{k: r[k] for k in ("x", "y", "text", "cluster", "n")} for r in labels])
    write_json(spark, f"{path}/labels3d.json", [{"x": r["sx"], "y": r["sy"], "z": r["sz"], **{k: r[k] for k in ("text", "cluster", "n")}} for r in labels])
    levels, sizes = lod_of(points, lods)
    levels.write.mode("overwrite").partitionBy("lod").parquet(f"{path}/lods.parquet")
    stats: dict[str, dict] = {}
    for r in cluster_stats(points).collect():  # metrics times clusters
        stats.setdefault(str(r["cluster"]), {})[r["metric"]] = r["trimmed"]
    write_json(spark, f"{path}/cluster_stats.json", stats)
    if details is not None:
        details.write.mode("overwrite").json(f"{path}/cluster_details.jsonl")
    for metric, rows in (contours or {}).items():
        write_json(spark, f"{path}/contours/{metric}.json", rows)
    spark.dataSource.register(PointsSource)
    for name, schema in (("points.f32", SCHEMA_2D), ("points3d.f32", SCHEMA_3D)):
        flat = points.orderBy("pos").select(*[F.col(c).cast("float").alias(c) for c in schema])
        flat.write.format("points_f32").option("path", f"{path}/{name}").mode("append").save()
    known = points.agg(F.count("*").alias("n"), F.sum("is_labeled").alias("labeled"), F.count_if(F.col("ranked") >= 0).alias("ranked"), *[F.count(m).alias(m) for m in METRICS]).first()
    meta = {
        "n_points": known["n"], "labeled_count": known["labeled"] or 0, "ranked_known_count": known["ranked"], **{f"{m}_known_count": known[m] for m in METRICS},
        "binary_points_schema": list(SCHEMA_2D), "binary_points_stride": len(SCHEMA_2D), "binary_points3d_schema": list(SCHEMA_3D), "binary_points3d_stride": len(SCHEMA_3D),
        "lod_sizes": sizes, "sphere_radius": radius, "contour_metrics": sorted(contours or {}), "contour_total_segments": sum(len(x) for x in (contours or {}).values()), **(said or {}),
    }
    write_json(spark, f"{path}/meta.json", meta)
    return meta


#: The sliders whose upper end is open: a range that reaches it has no upper bound.
OPEN_TOP = {"star": 15.0, "bpm": 300.0}


def visible(points: DataFrame, labelled_only: bool = False, ranked: str = "all", ranges: dict[str, tuple[float, float]] | None = None, keep_unknown: bool = False) -> DataFrame:
    """The points that the viewer's filters leave: labelled or all; ranked, unranked or all; each metric within its range.

    Unknown metrics fail a range unless keep_unknown. At the open ends of star and bpm nothing is too large.
    """
    if ranked not in ("all", "ranked", "unranked"):
        raise ValueError(f"unknown mode {ranked}")
    keep = F.lit(True)
    if labelled_only:
        keep &= F.col("is_labeled") == 1
    if ranked != "all":
        keep &= F.col("ranked") == (1 if ranked == "ranked" else 0)
    for m, (lo, hi) in (ranges or {}).items():
        inside = F.col(m) >= lo if m in OPEN_TOP and hi >= OPEN_TOP[m] else F.col(m).between(lo, hi)
        keep &= F.coalesce(inside, F.lit(keep_unknown))
    return points.filter(keep)


def search(points: DataFrame, map_id: str | None = None, mapper: str | None = None) -> DataFrame:
    """The point with an id, or all points of a mapper whatever the case of letters."""
    if map_id is not None:
        return points.filter(F.col("map_id").cast("string") == map_id.strip())
    return points.filter(F.lower("creator") == (mapper or "").strip().lower())


def top_of_user(scores: DataFrame, points: DataFrame, user: str, n: int = 100) -> DataFrame:
    """The points of a user's best scores, 100 at most. scores: (user_id, user_name, map_id, rank); the user by id or name."""
    mine = scores.filter((F.col("user_id").cast("string") == user) | (F.lower("user_name") == user.lower()))
    best = mine.orderBy("rank", "map_id").limit(max(0, min(n, 100))).select("map_id")
    return points.join(F.broadcast(best), "map_id", "left_semi")  # 100 rows
