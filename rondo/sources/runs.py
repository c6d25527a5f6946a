"""Run folders: features, standardizer and metrics of a training run, embedding chunks, clusters and sweeps, written and read back.

A run folder holds small JSON files of the driver and Parquet or CSV tables. Chunks of embeddings are registered in
progress/state.json only once they are whole, so an interrupted run goes on where it stopped and readers see whole chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import numeric_order
from .files import exists, read_json, write_json

DEFAULT_ROOT = "dataset"


def write_run(spark: SparkSession, run_dir: str, features: list[str], fit: DataFrame, config: dict[str, Any]) -> None:
    """Feature list, standardizer (feature, median, mean, std) and configuration of a run."""
    write_json(spark, f"{run_dir}/feature_columns.json", features)
    rows = {r["feature"]: (r["median"], r["mean"], r["std"]) for r in fit.collect()}  # one row a feature
    write_json(spark, f"{run_dir}/preprocess.json", {name: [rows[f][k] for f in features] for k, name in enumerate(("median", "mean", "std"))})
    write_json(spark, f"{run_dir}/config.json", config)


def append_metrics(spark: SparkSession, run_dir: str, epoch: int, metrics: dict[str, float]) -> None:
    """Metrics of an epoch; a repeated epoch replaces its former metrics."""
    known = [m for m in read_json(spark, f"{run_dir}/metrics.json") or [] if m["epoch"] != epoch]
    write_json(spark, f"{run_dir}/metrics.json", sorted([*known, {"epoch": epoch, **metrics}], key=lambda m: m["epoch"]))


def write_checkpoint(spark: SparkSession, run_dir: str, epoch: int, weights: dict[str, np.ndarray], features: list[str], preprocess: dict[str, list[float]], config: dict[str, Any]) -> None:
    """The weights after an epoch with copies of all that is needed to use them."""
    body = {"epoch": epoch, "encoder_config": config, "feature_cols": features, "preprocess": preprocess, "weights": {k: {"shape": list(v.shape), "values": v.ravel().tolist()} for k, v in weights.items()}}
    write_json(spark, f"{run_dir}/checkpoints/epoch_{epoch:04d}.json", body)
    write_json(spark, f"{run_dir}/model.json", body)


def load_run(spark: SparkSession, run_dir: str) -> dict[str, Any]:
    """weights, config, features and preprocess of a run: the checkpoint's own copies, or else the files beside it."""
    state = read_json(spark, f"{run_dir}/model.json") or {}
    features = state.get("feature_cols") or read_json(spark, f"{run_dir}/feature_columns.json")
    preprocess = state.get("preprocess") or read_json(spark, f"{run_dir}/preprocess.json")
    if features is None or preprocess is None:
        raise FileNotFoundError(f"{run_dir} holds no run")
    config = {"input_dim": len(features), "hidden_dim": 256, "num_layers": 1, "dropout": 0.1, "proj_dim": 128} | (state.get("encoder_config") or {})
    weights = {k: np.array(v["values"], "float32").reshape(v["shape"]) for k, v in (state.get("weights") or {}).items()}
    return {"weights": weights, "config": config, "features": list(features), "preprocess": preprocess, "epoch": state.get("epoch")}


def dataset_root(spark: SparkSession, run_dir: str, default: str = DEFAULT_ROOT) -> str:
    """Where a run's data lie, by its progress state, or else its configuration, or else the default."""
    for name in ("progress/state.json", "config.json"):
        said = (read_json(spark, f"{run_dir}/{name}") or {}).get("dataset_root")
        if said:
            return str(said)
    return default


def embed_in_chunks(rows: DataFrame, ids: DataFrame, run_dir: str, embed: Callable[[DataFrame], DataFrame], every: int = 5000, root: str = DEFAULT_ROOT, key: str = "map_id") -> dict[str, Any]:
    """Embed all ids in numeric-aware order, `every` of them a chunk; chunks that are registered already aren't made again.

    embed takes the rows of a chunk's maps and gives (map_id, embedding); a map without an embedding is passed over. Another
    set of ids begins anew. Returns the state.
    """
    spark = rows.sparkSession
    path = f"{run_dir}/progress/state.json"
    named = numeric_order(ids.select(F.col(key).cast("string").alias("id")).distinct(), "id")
    n = named.count()
    same = named.agg(F.sum(F.xxhash64("id").cast("decimal(20,0)"))).first()[0]
    state = read_json(spark, path)
    if not state or state.get("map_count") != n or state.get("ids") != str(same):
        state = {"next_index": 0, "map_count": n, "ids": str(same), "dataset_root": root, "chunks": []}
        write_json(spark, path, state)
    while state["next_index"] < n:
        lo, hi, c = state["next_index"], min(n, state["next_index"] + every), len(state["chunks"])
        mine = F.broadcast(named.filter(F.col("pos").between(lo + 1, hi)).select("id"))  # `every` rows
        part = rows.join(mine, F.col(key).cast("string") == F.col("id"), "left_semi")
        name = f"chunk_{c:06d}_{lo}"
        embed(part).select(F.col(key).cast("string").alias("map_id"), "embedding").write.mode("overwrite").parquet(f"{run_dir}/progress/{name}")
        state["chunks"].append({"path": name, "n": spark.read.parquet(f"{run_dir}/progress/{name}").count()})
        state["next_index"] = hi
        write_json(spark, path, state)
    return state


def read_chunks(spark: SparkSession, run_dir: str) -> DataFrame:
    """(map_id, embedding) of all registered chunks that are there; rows without id or embedding go."""
    state = read_json(spark, f"{run_dir}/progress/state.json")
    if state is None:
        raise FileNotFoundError(f"{run_dir} has no progress state")
    paths = [p for c in state.get("chunks", []) if exists(spark, p := f"{run_dir}/progress/{c['path']}")]
    if not paths:
        raise FileNotFoundError(f"{run_dir} has no chunks")
    return spark.read.parquet(*paths).select(F.col("map_id").cast("string"), "embedding").filter("map_id is not null and embedding is not null")


def write_clusters(clusters: DataFrame, embeddings: DataFrame, run_dir: str, config: dict[str, Any], centroids: np.ndarray | None = None) -> None:
    """Clusters as CSV (map_id, cluster), embeddings as Parquet, the configuration, and centroids where the method has them."""
    spark = clusters.sparkSession
    clusters.select("map_id", "cluster").write.mode("overwrite").csv(f"{run_dir}/clusters.csv", header=True)
    embeddings.select("map_id", "embedding").write.mode("overwrite").parquet(f"{run_dir}/embeddings.parquet")
    write_json(spark, f"{run_dir}/cluster_config.json", config | {"n_maps_clustered": clusters.count(), "minibatch": config.get("method") == "minibatch_kmeans"})
    if centroids is not None:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cluster int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{run_dir}/cluster_centroids.parquet")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, cluster) of a cluster CSV, whatever other columns it has; ids stay text."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("map_id").cast("string"), F.col("cluster").try_cast("int").alias("cluster"))


def clustered_embeddings(embeddings: DataFrame, clusters: DataFrame, order: str | None = None) -> DataFrame:
    """(map_id, embedding, cluster): joined on the cleaned id; of clusters with equal ids the last by `order` counts, or the greatest."""
    from ..functions.scalars import normal_id

    e = embeddings.withColumn("id", normal_id(F.col("map_id").cast("string")))
    c = clusters.groupBy(normal_id(F.col("map_id").cast("string")).alias("id")).agg((F.max_by("cluster", order) if order else F.max("cluster")).alias("cluster"))
    return e.join(c, "id").select("map_id", "embedding", "cluster")


def write_elbow(sweep: DataFrame, run_dir: str, suggested: int | None = None) -> None:
    """A sweep as CSV and as JSON with its settings."""
    spark = sweep.sparkSession
    sweep.orderBy("k").coalesce(1).write.mode("overwrite").csv(f"{run_dir}/elbow_k.csv", header=True)
    rows = [r.asDict() for r in sweep.orderBy("k").collect()]  # one row a k
    head = rows[0] if rows else {}
    write_json(spark, f"{run_dir}/elbow_k.json", {"run_dir": run_dir, "k_values": [r["k"] for r in rows], "sample_size": head.get("n_points"), "dim": head.get("dim"), "algorithm": head.get("algorithm"), "suggested_k": suggested, "results": rows})
