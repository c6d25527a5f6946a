"""Vector operators: centroids, nearest centroid, k nearest neighbours, contrastive loss, standardisation, covariance, projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp, dot, finite, unit
from .quantiles import quantiles
from .sampling import exact_sample, hash_order

#: Rows of a small side that are compared with everything; a larger side is refused, not broadcast.
SMALL_SIDE = 100_000


def checked_small(df: DataFrame, limit: int = SMALL_SIDE) -> DataFrame:
    """df with a broadcast hint once its row count is known to be at most limit."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows to compare everything with")
    return F.broadcast(df)


def centroids(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector per cluster. Positions are averaged apart, so the aggregation combines before the shuffle."""
    long = rows.select(cluster, F.posexplode(vector).alias("pos", "v"))
    g = long.groupBy(cluster, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return g.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("centroid"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, cents: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(key, cluster, sim): the centroid with the largest cosine; of equal ones the first. Absent clusters never win; null vectors have none.

    All centroids are one broadcast row, and each vector takes its best of them in a projection: nothing is shuffled.
    """
    few = cents.select(F.col(cluster).alias("k"), unit(F.col("centroid")).alias("c")).filter("c is not null")
    if few.limit(SMALL_SIDE + 1).count() > SMALL_SIDE:
        raise ValueError(f"more than {SMALL_SIDE} centroids to compare everything with")
    one = F.broadcast(few.agg(F.collect_list(F.struct("k", "c")).alias("all")))
    u = rows.select(F.col(key).alias("key"), unit(F.col(vector)).alias("u")).crossJoin(one)
    best = F.array_max(F.transform("all", lambda c: F.struct(dot(F.col("u"), c["c"]).alias("sim"), (-c["k"]).alias("neg"))))
    out = u.select("key", best.alias("m")).filter("m.sim is not null")
    return out.select(F.col("key").alias(key), (-F.col("m.neg")).alias(cluster), F.col("m.sim").alias("sim"))


#: Distances of queries and rows that a task holds at once.
CELLS = 1 << 21


def knn(queries: DataFrame, qkey: str, qvec: str, base: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(qkey, key, dist, rank): the k nearest rows of base for each of a small, stated set of queries.

    Each task compares its rows with all queries by matrix products and keeps k of each query, so k rows a query and task are
    shuffled. Of equal distances the smaller key is nearer. Null vectors are far from everything.
    """
    got = checked_small(queries.select(F.col(qkey).alias("q"), F.col(qvec).alias("v")).filter("v is not null")).collect()
    names = [r["q"] for r in got]
    x = np.array([r["v"] for r in got], float) if got else np.zeros((0, 1))

    def local(batches):
        best: pd.DataFrame | None = None
        for b in batches:
            for at in range(0, len(b), max(1, CELLS // max(1, len(x)))):
                part = b.iloc[at : at + max(1, CELLS // max(1, len(x)))]
                y = np.stack(part["v"].to_numpy()).astype(float)
                d2 = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
                most = min(k, len(y)) - 1
                edge = np.partition(d2, most, axis=1)[:, most] + 1e-9  # rounding must not part equal distances
                qi, yi = np.nonzero(d2 <= edge[:, None])
                new = pd.DataFrame({"q": qi, "k": part["k"].to_numpy()[yi], "dist": np.sqrt(((x[qi] - y[yi]) ** 2).sum(1))})
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["q", "dist", "k"]).groupby("q", sort=False).head(k)
        if best is not None and len(best):
            yield best

    kind = base.schema[key].dataType.simpleString()
    near = base.select(F.col(key).alias("k"), F.col(vec).alias("v")).filter("v is not null").mapInPandas(local, f"q int, k {kind}, dist double") if len(x) else base.select(F.lit(0).alias("q"), F.col(key).alias("k"), F.lit(0e0).alias("dist")).limit(0)
    top = near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("dist", "k"))).filter(F.col("rank") <= k)
    named = queries.sparkSession.createDataFrame(list(enumerate(names)), f"q int, name {queries.schema[qkey].dataType.simpleString()}")
    return top.join(F.broadcast(named), "q").select(F.col("name").alias(qkey), F.col("k").alias(key), "dist", "rank")


def infonce(pairs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Symmetric contrastive loss of rows (batch, item, a, b): views a and b of an item are each other's positive.

    Every view meets the other views of its batch only, and batches are small by design. An item with one view, as at
    the end of a last, partial batch, is a negative of the others and has no loss of its own.
    """
    views = pairs.select("batch", "item", F.lit(0).alias("side"), unit(F.col("a")).alias("v")).union(pairs.select("batch", "item", F.lit(1), unit(F.col("b")))).filter("v is not null")
    other = views.select(F.col("batch").alias("b2"), F.col("item").alias("i2"), F.col("side").alias("s2"), F.col("v").alias("v2"))
    j = views.join(other, (F.col("batch") == F.col("b2")) & ((F.col("item") != F.col("i2")) | (F.col("side") != F.col("s2"))))
    s = j.withColumn("s", dot(F.col("v"), F.col("v2")) / temperature)
    row = s.groupBy("batch", "item", "side").agg(F.ln(F.sum(F.exp("s"))).alias("lse"), F.max(F.when(F.col("item") == F.col("i2"), F.col("s"))).alias("pos"))
    return row.groupBy("batch").agg(F.avg(F.col("lse") - F.col("pos")).alias("loss"))


def fit_standardizer(rows: DataFrame, columns: Sequence[str], limit: float | None = 1e6) -> DataFrame:
    """(feature, median, mean, std) in long form: median of the finite values, then mean and deviation with gaps filled.

    Medians are exact and found in bounded memory; mean and deviation are one partial aggregate for each column.
    """
    at = {c: finite(F.col(f"`{c}`").cast("double")) for c in columns}
    at = {c: clamp(v, -limit, limit) if limit else v for c, v in at.items()}
    clean = rows.select(*[v.alias(c) for c, v in at.items()])
    medians = {c: v or 0.0 for (c, _), v in quantiles(clean, list(columns), [0.5]).items()}
    filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(m)) for c, m in medians.items()}
    g = clean.agg(*[f(v).alias(f"{name}{k}") for k, v in enumerate(filled.values()) for name, f in (("m", F.avg), ("s", F.stddev_pop))])
    fits = [F.struct(F.lit(c).alias("feature"), F.lit(medians[c]).alias("median"), F.col(f"m{k}").alias("mean"), F.when(F.col(f"s{k}") <= 1e-8, 1.0).otherwise(F.col(f"s{k}")).alias("std")) for k, c in enumerate(columns)]
    return g.select(F.explode(F.array(*fits)).alias("f")).select("f.*").filter("mean is not null")


def sampled_rows(rows: DataFrame, key: str, order: Sequence[str], maps: int = 2000, each: int = 64, seed: int = 2025) -> DataFrame:
    """At most `each` rows of at most `maps` maps, the same in any run: the bounded sample that a standardizer may be fitted on."""
    some = F.broadcast(exact_sample(rows.select(key).distinct(), key, maps, seed))  # maps rows
    mine = rows.join(some, key, "left_semi")
    names = F.concat_ws("|", F.col(key).cast("string"), *[F.col(c).cast("string") for c in order])
    w = W.partitionBy(key).orderBy(hash_order(names, seed), *order)
    nth = _free(rows, "nth")
    return mine.withColumn(nth, F.row_number().over(w)).filter(F.col(nth) <= each).drop(nth)


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def standardize(rows: DataFrame, fitted: dict[str, tuple[float, float, float]], limit: float | None = 50.0) -> DataFrame:
    """Fill with the median, subtract the mean, divide by the deviation, clip."""
    out = {}
    for c, (median, mean, std) in fitted.items():
        z = (F.coalesce(finite(F.col(c).cast("double")), F.lit(median)) - mean) / std
        out[c] = clamp(z, -limit, limit) if limit else z
    return rows.withColumns(out)


def fitted_values(fit: DataFrame) -> dict[str, tuple[float, float, float]]:
    """The fitted rows, one per column, on the driver."""
    return {r["feature"]: (r["median"], r["mean"], r["std"]) for r in fit.collect()}


def moments(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population covariance) of all positions. Sums and products are made per task; a dims x dims matrix reaches the driver.

    Null vectors are left out; without any vector both are empty.
    """
    some = rows.select(vector).filter(F.col(vector).isNotNull()).first()
    dims = len(some[0]) if some else 0
    if not dims:
        return np.zeros(0), np.zeros((0, 0))

    def sums(batches):
        n, s, p = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pd.DataFrame({"i": range(dims), "n": n, "s": s, "p": list(p)})

    parts = rows.select(vector).filter(F.col(vector).isNotNull()).mapInPandas(sums, "i int, n long, s double, p array<double>")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *[F.sum(F.col("p")[j]).alias(f"p{j}") for j in range(dims)]).orderBy("i").collect()
    n = got[0]["n"]
    mean = np.array([r["s"] for r in got]) / n
    return mean, np.array([[r[f"p{j}"] for j in range(dims)] for r in got]) / n - np.outer(mean, mean)


def covariance(rows: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """(i, j, cov): population covariance of all positions, or of the first dims, i <= j."""
    _, cov = moments(rows, vector)
    dims = len(cov) if dims is None else dims
    data = [(i, j, float(cov[i, j])) for i in range(dims) for j in range(i, dims)]
    return rows.sparkSession.createDataFrame(data, "i int, j int, cov double")


#: Terms of a projection that is still written as one expression; beyond, code generation would give up.
EXPRESSION = 512


def pca(rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Coordinates on the first k principal axes, centred; the largest loading of each axis is positive."""
    mean, cov = moments(rows, vector)
    dims = len(mean)
    if not dims:
        return rows.select(key, *[F.lit(None).cast("double").alias(f"pc{c + 1}") for c in range(k)])
    _, vec = np.linalg.eigh(cov)
    axes = vec[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(k)])
    if k * dims > EXPRESSION:

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else ((np.asarray(x, float) - mean) @ axes).tolist())

        return rows.select(F.col(key), project(F.col(vector)).alias("__pc")).select(key, *[F.col("__pc")[c].alias(f"pc{c + 1}") for c in range(k)])
    out = [sum((F.element_at(vector, i + 1).cast("double") - float(mean[i])) * float(axes[i, c]) for i in range(dims)).alias(f"pc{c + 1}") for c in range(k)]
    return rows.select(key, *out)


def on_sphere(points: DataFrame, key: str, cols: Sequence[str] = ("pc1", "pc2", "pc3"), radius: float = 1.0) -> DataFrame:
    n = F.sqrt(sum(F.col(c) * F.col(c) for c in cols)) + 1e-9
    return points.select(key, *[(F.col(c) / n * radius).alias(c) for c in cols])
