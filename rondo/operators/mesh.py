"""A spherical mesh, fields on its vertices, smoothing, iso-lines and faces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import quantiles
from .vectors import CELLS, checked_small


def icosphere(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and outward faces after n (1 to 7) midpoint subdivisions: 10 * 4^n + 2 and 20 * 4^n."""
    n = min(7, max(1, n))
    g = (1 + 5**0.5) / 2
    base = [(s * a, t * b, 0.0) for a, b in ((1.0, g),) for s in (-1, 1) for t in (-1, 1)]
    v = np.array([p for q in base for p in (q, (q[2], q[0], q[1]), (q[1], q[2], q[0]))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # Faces are the triples of mutually nearest vertices.
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    near = (d > 0) & (d < d[d > 0].min() * 1.01)
    f = np.array([(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if near[a, b] and near[b, c] and near[a, c]])
    inward = np.einsum("ij,ij->i", np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]), v[f].sum(1)) < 0
    f[inward] = f[inward][:, ::-1]
    for _ in range(n):
        e = np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1)
        u, at = np.unique(e, axis=0, return_inverse=True)
        mid = v[u[:, 0]] + v[u[:, 1]]
        m = len(v) + at.reshape(3, -1).T
        v = np.concatenate([v, mid / np.linalg.norm(mid, axis=1, keepdims=True)])
        f = np.concatenate([np.stack(t, axis=1) for t in ((f[:, 0], m[:, 0], m[:, 2]), (f[:, 1], m[:, 1], m[:, 0]), (f[:, 2], m[:, 2], m[:, 1]), (m[:, 0], m[:, 1], m[:, 2]))])
    return v, f


def mesh_tables(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices (v, x, y, z), faces (face, a, b, c), distinct undirected edges (a, b))."""
    v, f = icosphere(n)
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "v int, x double, y double, z double")
    faces = spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(f)], "face int, a int, b int, c int")
    sides = faces.select(F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("a", "c"))])).alias("e"))
    return vertices, faces, sides.select("e.a", "e.b").distinct()


def vertex_field(points: DataFrame, vertices: DataFrame, k: int = 48, compat: bool = False) -> DataFrame:
    """(v, value): Gaussian-weighted mean of the k nearest points (x, y, z, value, weight) of each mesh vertex.

    The mesh is bounded; each task keeps its own k best per vertex before the shuffle. Missing values count as the
    median of all, or as nothing with compat.
    """
    mesh = np.array([(r["x"], r["y"], r["z"]) for r in checked_small(vertices, 170_000).orderBy("v").collect()])
    med = quantiles(points, ["value"], [0.5])["value", 0.5]

    def local(batches):

        best: pd.DataFrame | None = None
        step = max(1, CELLS // max(1, len(mesh)))
        for b in (b.iloc[at : at + step] for b in batches for at in range(0, len(b), step)):
            p = b[["x", "y", "z"]].to_numpy()
            d = np.sqrt(np.maximum((mesh**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * mesh @ p.T, 0))
            m = min(k, d.shape[1])
            at = np.argpartition(d, m - 1, axis=1)[:, :m] if d.shape[1] > m else np.tile(np.arange(m), (len(mesh), 1))
            new = pd.DataFrame({"v": np.repeat(np.arange(len(mesh)), m), "id": b["id"].to_numpy()[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel(), "value": b["value"].to_numpy()[at].ravel(), "weight": b["weight"].to_numpy()[at].ravel()})
            best = new if best is None else pd.concat([best, new])
            best = best.sort_values(["v", "d", "id"]).groupby("v", sort=False).head(k)
        if best is not None:
            yield best

    near = points.select("id", "x", "y", "z", "value", "weight").mapInPandas(local, "v int, id long, d double, value double, weight double")
    from pyspark.sql import Window as W

    w = W.partitionBy("v").orderBy("d", "id")
    top = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    sigma = max(1e-4, 1.5 * (top.filter("rank = 1").agg(F.median("d")).first()[0] or 0.0))
    val = F.col("value") if compat else F.coalesce("value", F.lit(med))
    g = F.when(val.isNotNull(), F.col("weight") * F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma)))
    return top.groupBy("v").agg((F.coalesce(F.sum(g * val), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(g), F.lit(0.0)), F.lit(1e-8))).alias("value"))


def smooth(field: DataFrame, edges: DataFrame, passes: int = 1) -> DataFrame:
    """Each pass: the mean of a vertex and its neighbours. A mesh has at most 163,842 vertices, so all passes are one step on arrays."""

    def step(own: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        names, v = own["v"].to_numpy(), own["value"].to_numpy(float)
        order = np.argsort(names)
        at = lambda c: order[np.searchsorted(names, sides[c].to_numpy(), sorter=order)]
        a, b = at("a"), at("b")
        n = 1 + np.bincount(a, minlength=len(v)) + np.bincount(b, minlength=len(v))
        for _ in range(passes):
            v = (v + np.bincount(a, v[b], minlength=len(v)) + np.bincount(b, v[a], minlength=len(v))) / n
        return pd.DataFrame({"v": names, "value": v})

    one = F.lit(0).alias("all")
    return field.select("v", "value").groupBy(one).cogroup(edges.select("a", "b").groupBy(one)).applyInPandas(step, field.select("v", "value").schema)


def face_values(faces: DataFrame, field: DataFrame) -> DataFrame:
    """(face, value): mean of the three corners, four digits."""
    corners = faces.select("face", F.explode(F.array("a", "b", "c")).alias("v")).join(field, "v")
    return corners.groupBy("face").agg(F.bround(F.avg("value"), 4).alias("value"))


def iso_lines(faces: DataFrame, vertices: DataFrame, field: DataFrame, levels: list[float], step: float = 0.05, most: int = 24, radius: float = 1.01) -> DataFrame:
    """(level, face, path): where a level crosses two edges of a face, an arc on the sphere between the crossings."""
    pts = vertices.join(field, "v").select("v", F.struct("x", "y", "z", "value").alias("p"))
    f = faces
    for c in "abc":
        f = f.join(pts.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")), c)
    f = f.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))

    def cross(p, q):
        t = (F.col("level") - p["value"]) / (q["value"] - p["value"])
        at = F.struct(*[(p[a] + t * (q[a] - p[a])).alias(a) for a in "xyz"])
        return F.when((p["value"] >= F.col("level")) != (q["value"] >= F.col("level")), at)

    ends = F.filter(F.array(*[cross(F.col(f"p{a}"), F.col(f"p{b}")) for a, b in ("ab", "bc", "ca")]), lambda e: e.isNotNull())
    f = f.select("level", "face", ends.alias("e")).filter(F.size("e") == 2)
    unit = lambda s: F.transform(F.array(s["x"], s["y"], s["z"]), lambda v: v / F.sqrt(s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"]))
    f = f.select("level", "face", unit(F.get("e", F.lit(0))).alias("u"), unit(F.get("e", F.lit(1))).alias("w"))
    dot = F.least(F.greatest(sum(F.get("u", F.lit(i)) * F.get("w", F.lit(i)) for i in range(3)), F.lit(-1.0)), F.lit(1.0))
    f = f.withColumn("angle", F.acos(dot)).filter("angle > 1e-5")
    n = F.least(F.lit(most - 1), F.greatest(F.lit(1), F.ceil(F.col("angle") / step).cast("int")))
    t = F.transform(F.sequence(F.lit(0), n), lambda i: i / n)
    slerp = lambda s: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: radius * (F.sin((1 - s) * F.col("angle")) * F.get("u", i) + F.sin(s * F.col("angle")) * F.get("w", i)) / F.sin("angle"))
    return f.select("level", "face", F.transform(t, slerp).alias("path"))
