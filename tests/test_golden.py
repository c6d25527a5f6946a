"""Hand-derived values and properties of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.functions import scalars as S
from rondo.operators import clustering as C
from rondo.operators import density as D
from rondo.operators import mesh as M
from rondo.operators import notes as N
from rondo.operators import quality, sequences, tags, vectors, windows
from rondo.sources import sinks
from rondo.streaming import events as E

SQUARE = [(0, 100.0, 100.0, 1000), (1, 200.0, 100.0, 1250), (2, 200.0, 200.0, 1500), (3, 100.0, 200.0, 1750), (4, 100.0, 100.0, 2000)]


@pytest.fixture(scope="module")
def square(spark):
    rows = [("m", i, x, y, t, "circle", None, None, None, 500.0, 1200) for i, x, y, t in SQUARE]
    return spark.createDataFrame(rows, "map_id string, line_no int, x double, y double, t_ms long, obj_type string, slider_dur double, slider_end_x double, slider_end_y double, beat_ms double, preempt_ms long")


def column(df, name):
    return [r[name] for r in df.orderBy("line_no").collect()]


def test_square_path(square):
    assert column(N.deltas(square), "dt_prev") == [None, 250, 250, 250, 250]
    a = N.angles(square)
    assert column(a, "jump_type") == [-1, 2, 2, 2, -1]
    assert column(a, "angle")[1:4] == pytest.approx([90, 90, 90])
    k = N.kinematics(square)
    assert column(k, "vel_x")[1:] == pytest.approx([0.4, 0, -0.4, 0])
    assert column(k, "bearing")[1:] == pytest.approx([0, 90, 180, 270])
    assert column(k, "accel_mag")[2] == pytest.approx(0.00226274, rel=1e-4)
    assert column(k, "jerk_mag")[3] == pytest.approx(1.28e-5, rel=1e-3)
    ab = N.absement(N.deltas(square))
    assert column(ab, "absement_x") == [0, 50000, 100000, 125000, 150000]
    assert column(ab, "absity_x") == [0, 12500000, 37500000, 68750000, 106250000]
    assert column(N.visual_density(square), "vis_density") == [1, 2, 3, 4, 5]
    assert column(N.squareness(square), "poly_sq")[3] == pytest.approx(1.0)
    assert column(N.ring_stats(square), "dt_cv")[3:] == [0, 0]
    assert column(N.ring_entropy(square), "rhythm_complexity")[3:] == [0, 0]
    assert column(N.center_stats(square), "edge_proximity") == pytest.approx([0.520833, 0.520833, 0.958333, 0.520833, 0.520833], abs=1e-6)


def test_rounding_beyond_the_largest_long(spark):
    values = [178277183205618.4, -178277183205618.4, 5e32, -9223372036854.7, 4503599627.3704955, 4503599627.370497, 1.0000005, -0.0000005, 0.0]
    d = spark.createDataFrame([(v,) for v in [*values, math.inf, -math.inf, math.nan, None]], "v double")
    got = [r["r"] for r in d.select(S.rounded(F.col("v")).alias("r")).collect()]
    assert got[: len(values)] == [math.floor(v * 1e6 + 0.5) / 1e6 for v in values]
    assert got[-4:-2] == [math.inf, -math.inf] and math.isnan(got[-2]) and got[-1] is None


def test_square_windows(square):
    b = windows.map_bounds(square)
    assert b.first()["t_end"] == 2500
    w = windows.beat_windows(b).orderBy("k").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in w] == [(1000, 2500), (2000, 2500)]
    f = N.center_stats(N.kinematics(N.angles(N.deltas(square))))
    g = windows.aggregates(windows.assign(f, b)).orderBy("k").collect()
    assert [r["n_obj"] for r in g] == [5, 1]
    assert g[0]["bearing_var"] == pytest.approx(1.0) and g[0]["dominant"] == 2 and g[1]["density_delta"] == -4 and g[1]["intensity_slope"] is None


def test_equal_times_and_single_event(spark):
    d = spark.createDataFrame([("a", i, 1.0 * i, 0.0, 10, "circle", None, None, None) for i in range(3)] + [("b", 0, 1.0, 1.0, 5, "circle", None, None, None)], "map_id string, line_no int, x double, y double, t_ms long, obj_type string, slider_dur double, slider_end_x double, slider_end_y double")
    k = N.kinematics(d)
    assert k.filter("vel_x is not null").count() == 0
    assert N.gap_ring(d).filter("size(ring) > 0").count() == 0


def test_asof_before_first_point(spark):
    n = spark.createDataFrame([("m", 0, 10), ("k", 0, 10)], "map_id string, line_no int, t_ms long")
    t = spark.createDataFrame([("m", 1, 1000, 150.0)], "map_id string, line_no int, t_ms long, value double")
    got = {r["map_id"]: r["local_value"] for r in N.asof_timing(n, t).collect()}
    assert got == {"m": 150.0, "k": 120.0}


def test_trimmed_mean_and_percent_drop(spark):
    d = spark.createDataFrame([("c", 1.0)] * 9 + [("c", 100.0), ("e", None)], "c string, v double")
    got = {r["c"]: r["trimmed"] for r in tags.trimmed_means(d, "c", "v").collect()}
    assert got == {"c": 1.0, "e": None}
    e = spark.createDataFrame([(2, 100.0), (3, 60.0), (4, 50.0), (5, 49.0)], "k int, inertia double")
    from pyspark.sql import Window as W

    before = F.lag("inertia").over(W.orderBy("k"))
    e = e.withColumn("delta_abs", before - F.col("inertia")).withColumn("delta_pct", F.coalesce(S.percent_drop(before, F.col("inertia")), F.lit(0.0)))
    assert C.suggested_k(e).first()[0] == 5 and C.suggested_k(e, compat=True).first()[0] == 2


def test_enrichment(spark):
    m = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1), ("4", 1)], "map_id string, cluster int")
    t = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "map_id string, tag string")
    got = tags.enrichment(m, t).filter("cluster = 0").first()
    assert got["enrichment"] == pytest.approx(math.log(1.5), abs=1e-6)


def test_hole_filling(spark):
    g = spark.createDataFrame([(0, 0, 4.0)], "ix int, iy int, value double")
    full = D.dense(g, 5)
    old = {(r["ix"], r["iy"]): r["value"] for r in D.fill_holes(full, 5, 1, compat=True).collect()}
    assert old[0, 1] == 4.0 and old[4, 4] == 0.0
    new = D.fill_holes(full, 5, 4).agg(F.min("value"), F.max("value")).first()
    assert tuple(new) == (4.0, 4.0)


def test_icosphere_euler():
    for n in (1, 3):
        v, f = M.icosphere(n)
        assert len(v) == 10 * 4**n + 2 and len(f) == 20 * 4**n
        e = {tuple(sorted(p)) for t in f.tolist() for p in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        assert len(v) - len(e) + len(f) == 2
        out = np.einsum("ij,ij->i", np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]), v[f].sum(1))
        assert (out > 0).all()


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single"])
def test_linkage(method):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 5, 10)])
    z = C.linkage(x, method)
    assert (np.diff(z[:, 2]) > -1e-9).all()
    lab = C.cut(z, len(x), 3)
    assert [len(set(lab[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(lab)) == 3
    assert len(set(C.cut(z, len(x), distance=float(z[-1, 2]) + 1))) == 1


def test_density_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal(3, 0.05, (30, 2))])
    lab = C.density_groups(x, 5)
    assert len({*lab[:30]} - {-1}) == 1 and len({*lab[30:]} - {-1}) == 1 and set(lab[:30]) != set(lab[30:])
    assert (C.density_groups(x[:3], 5) == -1).all()


def test_encoder_learns():
    rng = np.random.default_rng(2)
    seqs = [np.cumsum(rng.normal(m, 1, (30, 2)), axis=0) / 30 for m in rng.normal(0, 2, 24)]
    enc = sequences.Encoder.new(2)
    losses = sequences.train_projection(enc, seqs, epochs=6, batch=12)
    assert losses[-1] < losses[0]
    assert np.linalg.norm(enc.embed(seqs[0])) == pytest.approx(1.0) and not enc.embed(np.zeros((0, 2))).any()
    assert len(sequences.augment(seqs[0], np.random.default_rng(0), 50)) == 50


def test_standardizer_handles_missing_columns(spark):
    d = spark.createDataFrame([(1.0, None), (3.0, None), (None, None), (float("inf"), None)], "a double, b double")
    f = vectors.fitted_values(vectors.fit_standardizer(d, ["a", "b"]))
    assert f["b"] == (0.0, 0.0, 1.0) and f["a"][0] == 2.0
    assert all(v == 0 for (v,) in vectors.standardize(d, f).select("b").collect())


def test_broadcast_is_refused_beyond_its_bound(spark):
    with pytest.raises(ValueError):
        vectors.checked_small(spark.range(11), 10)


def test_conform(spark):
    d = spark.createDataFrame([(1, 2.0)], "b int, a double")
    assert quality.missing_columns(d, ["a", "z"]) == ["z"]
    assert quality.conform(d, ["a", "z"]).first() == (2.0, None)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "map_id string, x double, y double")
    sinks.write_bucketed(d, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    for _ in range(2):
        sinks.append_new(spark, d, f"{tmp_path}/u", ["map_id"])
    assert spark.read.parquet(f"{tmp_path}/u").count() == 2
    spark.dataSource.register(sinks.PointsSource)
    d.select("x", "y").coalesce(1).write.format("points_f32").mode("append").save(f"{tmp_path}/p")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "p").glob("*.f32")))
    assert sorted(np.frombuffer(data, "<f4").reshape(-1, 2).tolist()) == [[1, 2], [3, 4]]
    assert len(sinks.pack_points(d, ["x", "y"]).first()["packed"]) == 8


def test_npy_and_level_files(spark, tmp_path):
    from rondo.plans.text_plans import LEVEL
    from rondo.sources import level_text, tag_files

    np.save(tmp_path / "a.npy", np.arange(6, dtype="float32").reshape(3, 2))
    assert [r["vector"] for r in tag_files.read_npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "levels").mkdir()
    (tmp_path / "levels" / "7.txt").write_text("﻿" + LEVEL)
    (tmp_path / "levels" / "8.txt").write_text("no level")
    assert [r["map_id"] for r in level_text.read_levels(spark, str(tmp_path / "levels")).collect()] == ["7"]


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, t, float(t)) for t in (0, 10, 30)], "map_id long, t_ms long, x double")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    out = E.available_now(spark, E.stateful_kinematics(s), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [(r["t_ms"], r["vel_x"], r["absement_x"]) for r in out.orderBy("t_ms").collect()]
    assert got == [(0, None, 0.0), (10, 1.0, 100.0), (30, 1.0, 700.0)]
    d2 = spark.createDataFrame([(1, 40, 50.0)], d.schema)
    d2.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = E.available_now(spark, E.stateful_kinematics(s), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert out.count() == 4 and out.filter("t_ms = 40").first()["vel_x"] == 2.0


def test_everything_imports_without_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['rondo.llm'] = None; sys.modules['corpus_pipeline'] = None; import rondo.plans as p; p.load_all(); from rondo.plans.registry import QUERIES; assert len(QUERIES) > 60"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_whole_table_vector_queries(spark):
    from rondo.plans import load_all
    from rondo.plans.registry import QUERIES

    load_all()
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert QUERIES["pairwise_infonce_all"](spark, sf).count() == -(-n // 32) > 15
    assert QUERIES["covariance_matrix_all"](spark, sf).count() == 64 * 65 // 2


def test_contrastive_loss_of_a_partial_batch(spark):
    rows = [(0, 0, [1.0, 0.0], [0.8, 0.6]), (0, 1, [0.0, 1.0], None), (1, 2, [1.0, 1.0], None)]
    got = {r["batch"]: r["loss"] for r in vectors.infonce(spark.createDataFrame(rows, "batch int, item int, a array<double>, b array<double>"), 1.0).collect()}
    a, b = math.log(math.exp(0.8) + math.exp(0.0)) - 0.8, math.log(math.exp(0.8) + math.exp(0.6)) - 0.8
    assert got == {0: pytest.approx((a + b) / 2, abs=1e-6)}


def test_numeric_order_over_many_ranges(spark, monkeypatch):
    from rondo.operators import sampling

    monkeypatch.setattr(sampling, "BOUNDS_FROM", 100)
    ids = [str(i * 7 - 900) if i % 5 else f"x{i}" for i in range(700)] + ["007", "é", "", None]
    got = sampling.numeric_order(spark.createDataFrame([(i,) for i in ids], "id string").repartition(5), "id").orderBy("pos").collect()

    def rank(s):
        n = int(s) if s and s.lstrip("-").isdigit() else None
        return n is None, n or 0, s is not None, s or ""

    assert [r["pos"] for r in got] == list(range(1, len(ids) + 1)) and [r["id"] for r in got] == sorted(ids, key=rank)


def test_all_parts_and_line_items(spark):
    from rondo.plans import load_all
    from rondo.plans import tag_plans
    from rondo.plans.registry import QUERIES

    load_all()
    sf = "/root/testdata/sf0.001"
    assert QUERIES["numeric_aware_sort_all"](spark, sf).count() == spark.read.parquet(f"{sf}/part.parquet").count()
    assert tag_plans._rich_tags(spark, sf).select("map_id").distinct().count() == spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
