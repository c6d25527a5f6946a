"""Exact quantiles, grid and mesh steps and vector joins against direct computation."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.operators import density as D
from rondo.operators import mesh as M
from rondo.operators import vectors as V
from rondo.operators.quantiles import quantiles

PROBS = (0.0, 0.02, 0.5, 0.95, 1.0)
RNG = random.Random(4)
COLUMNS = {
    "spread": [RNG.gauss(0, 1) * 10 ** RNG.randrange(-3, 9) for _ in range(3000)],
    "ties": [float(RNG.randrange(4)) for _ in range(3000)],
    "one hot": [7.0] * 2000 + [RNG.random() for _ in range(1000)],
    "gaps": [None if k % 3 else float("nan") if k % 2 else RNG.random() for k in range(3000)],
    "edges": [RNG.choice((-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, float("inf"), float("-inf"))) for _ in range(3000)],
    "none": [None] * 3000,
    "near": [1 + k * 2.0**-52 for k in range(3000)],
}


def test_quantiles(spark):
    names = list(COLUMNS)
    d = spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"`{n}` double" for n in names))
    got = quantiles(d, names, PROBS)
    for n in names:
        v = sorted(x for x in COLUMNS[n] if x is not None and math.isfinite(x))
        for p in PROBS:
            if not v:
                assert got[n, p] is None
                continue
            at = p * (len(v) - 1)
            a, b = v[math.floor(at)], v[math.ceil(at)]
            assert got[n, p] == a + (b - a) * (at - math.floor(at)), (n, p)
    assert set(quantiles(d.limit(0), names[:2], [0.5]).values()) == {None}


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("passes", [1, 2, 12])
def test_fill_holes(spark, passes, compat):
    gs, rng = 12, random.Random(passes)
    a = [[rng.random() if rng.random() < 0.08 else None for _ in range(gs)] for _ in range(gs)]
    d = spark.createDataFrame([(i, j, a[i][j]) for i in range(gs) for j in range(gs)], "ix int, iy int, value double")
    t = time.time()
    out = D.fill_holes(d, gs, passes, compat)
    out._jdf.queryExecution().executedPlan().toString()
    assert time.time() - t < 2
    for _ in range(passes):
        b = [r[:] for r in a]
        for i in range(gs):
            for j in range(gs):
                if a[i][j] is None:
                    near = [a[min(max(i + x, 0), gs - 1)][min(max(j + y, 0), gs - 1)] for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
                    near = [x for x in near if x is not None]
                    b[i][j] = sum(near) / len(near) if near else 0.0 if compat else None
        a = b
    got = {(r["ix"], r["iy"]): r["value"] for r in out.collect()}
    assert len(got) == gs * gs
    for i in range(gs):
        for j in range(gs):
            assert got[i, j] is None if a[i][j] is None else got[i, j] == pytest.approx(a[i][j])


def test_smooth(spark):
    v, _, e = M.mesh_tables(spark, 1)
    rng = np.random.default_rng(2)
    value = rng.random(v.count())
    field = spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(value)], "v int, value double")
    sides = [tuple(r) for r in e.collect()]
    for _ in range(3):
        total, n = value.copy(), np.ones(len(value))
        for a, b in sides:
            total[a] += value[b]
            total[b] += value[a]
            n[[a, b]] += 1
        value = total / n
    got = {r["v"]: r["value"] for r in M.smooth(field, e, 3).collect()}
    assert [got[k] for k in range(len(value))] == pytest.approx(value)


def test_nearest_and_knn_with_ties_nulls_and_clashing_names(spark):
    rng = random.Random(9)
    vec = [[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(300)]
    rows = spark.createDataFrame([(k, x, 1, "u") for k, x in enumerate(vec)] + [(900, None, 1, "u")], "id long, v array<float>, all int, u string")
    q = rows.filter("id % 20 = 0 and v is not null")
    got = {}
    for r in V.knn(q, "id", "v", rows, "id", "v", 5).toDF("q", "id", "dist", "rank").orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["id"], r["dist"]))
    for k in range(0, 300, 20):
        want = sorted((math.dist(vec[k], x), i) for i, x in enumerate(vec))[:5]
        assert [i for i, _ in got[k]] == [i for _, i in want] and [d for _, d in got[k]] == pytest.approx([d for d, _ in want])
    cents = spark.createDataFrame([(3, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])], "cluster int, centroid array<double>")
    near = {r["id"]: r["cluster"] for r in V.nearest_centroid(rows, "id", "v", cents).collect()}
    assert 900 not in near and 3 not in near.values()
    for k, x in enumerate(vec):
        if x[0] != x[1]:
            assert near[k] == (1 if x[0] > x[1] else 2)
    assert V.knn(q.limit(0), "id", "v", rows, "id", "v", 5).count() == 0 == V.knn(q, "id", "v", rows.limit(0), "id", "v", 5).count()


def test_vectors_of_empty_tables(spark):
    d = spark.createDataFrame([], "id long, v array<double>")
    assert V.covariance(d, "v").count() == 0 and V.pca(d, "id", "v", 2).columns == ["id", "pc1", "pc2"]


def test_bounded_sample(spark):
    d = spark.range(5000).select((F.col("id") % 50).alias("map_id"), F.col("id").alias("k"))
    s = V.sampled_rows(d, "map_id", ["k"], maps=10, each=7)
    assert s.columns == d.columns and s.groupBy("map_id").count().filter("count = 7").count() == 10
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, V.sampled_rows(d.repartition(5), "map_id", ["k"], 10, 7).collect()))


def test_float32_points_of_attempts(spark, tmp_path):
    from rondo.sources.sinks import PointsSource

    spark.dataSource.register(PointsSource)
    d = spark.range(100, numPartitions=3).select(F.col("id").cast("float").alias("a"), (F.col("id") * 2).cast("float").alias("b"))
    path = str(tmp_path / "points")
    for mode, n in (("append", 100), ("append", 200), ("overwrite", 100)):
        d.write.format("points_f32").option("path", path).mode(mode).save()
        files = sorted((tmp_path / "points").iterdir())
        got = np.concatenate([np.fromfile(f, "<f4").reshape(-1, 2) for f in files])
        assert len(got) == n and all(f.name.startswith("points-") for f in files)
        assert (got[:100, 0] == np.arange(100)).all() and (got[:, 1] == 2 * got[:, 0]).all()


def test_clustering_of_any_size(spark):
    from rondo.operators import clustering as C

    rng = random.Random(3)
    rows = [(i, [rng.gauss(c, 0.1), rng.gauss(c, 0.1)]) for c in (0, 5, 10) for i in range(c * 100, c * 100 + 120)] + [(10_000 + i, [3.0, 3.0]) for i in range(150)] + [(99_999, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    sizes = C.bounded_groups(d.filter("v is not null"), "v", 3, most=50).groupBy("cluster").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and sum(r["count"] for r in sizes) == len(rows) - 1
    got = {r["id"]: r["cluster"] for r in C.recursive_agglomerative(d, "id", "v", 4, 3, 5, max_stage3=40, most=60).collect()}
    assert len(got) == len(rows) - 1 and len(set(got.values())) == 4
    for c in (0, 5, 10):
        assert len({got[i] for i in range(c * 100, c * 100 + 120)}) == 1
    out, cents, inertia = C.minibatch_kmeans(d, "id", "v", 4, batch=64, batches=20)
    assert out.count() == len(rows) and len(cents) == 4 and inertia > 0
    assert out.filter("cluster is null").count() == 1 and C.minibatch_kmeans(d.limit(0), "id", "v", 4)[0].count() == 0
    chain = np.array([[k * (k + 1) / 2, 0.0] for k in range(1500)])
    assert len(C.density_groups(chain, 5)) == 1500  # a dendrogram as deep as it has points


def test_run_folder(spark, tmp_path):
    from rondo.sources import files, runs

    path = str(tmp_path / "run")
    assert runs.dataset_root(spark, path) == runs.DEFAULT_ROOT and files.read_json(spark, f"{path}/none.json") is None
    fit = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)], "feature string, median double, mean double, std double")
    runs.write_run(spark, path, ["b", "a"], fit, {"dataset_root": "/x"})
    assert runs.load_run(spark, path)["preprocess"] == {"median": [4.0, 1.0], "mean": [5.0, 2.0], "std": [6.0, 3.0]} and runs.dataset_root(spark, path) == "/x"
    w = {"w": np.arange(6, dtype="float32").reshape(2, 3)}
    runs.write_checkpoint(spark, path, 3, w, ["c"], {"median": [0.0], "mean": [0.0], "std": [1.0]}, {"hidden_dim": 7})
    got = runs.load_run(spark, path)
    assert got["features"] == ["c"] and got["config"]["hidden_dim"] == 7 and got["config"]["proj_dim"] == 128 and (got["weights"]["w"] == w["w"]).all()
    for epoch, loss in ((1, 0.5), (2, 0.4), (1, 0.3)):
        runs.append_metrics(spark, path, epoch, {"loss": loss})
    assert files.read_json(spark, f"{path}/metrics.json") == [{"epoch": 1, "loss": 0.3}, {"epoch": 2, "loss": 0.4}]
    for f in ("7_w4b.parquet", "8_w4b.parquet", "x.txt"):
        (tmp_path / f).write_bytes(b"x")
    assert sorted(r["id"] for r in files.file_ids(spark, str(tmp_path)).collect()) == ["7", "8"]
    for k in (3, 12):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / f"maps/{k}_dir"))
    one = files.read_by_map(spark, str(tmp_path / "maps"), r"/(\d+)_dir/", order="id").groupBy("map_id").count().collect()
    assert sorted((r["map_id"], r["count"]) for r in one) == [("12", 3), ("3", 3)]
