"""Run artefacts, exports and the viewer, written and read back; and checks that SQL can say of fitted models."""

import math

from pyspark.sql import functions as F

from ..functions.scalars import rounded as R
from ..operators import clustering as C
from ..operators import mesh as M
from ..operators import tags as T
from ..operators import vectors as V
from ..sources import files, runs, sinks, viewer
from .adapters import r
from .registry import query, scratch, table
from .tag_plans import ENRICHED_ALL_SQL, _members, _rich_tags
from .vector_plans import CENT_SQL, DOT, LINE, _emb


def _ids(e):
    return e.select(F.col("vec_id").cast("string").alias("map_id"), "embedding", F.col("label").alias("cluster"))


@query("clusters_written", "SELECT vec_id::VARCHAR AS map_id, label AS cluster, len(embedding)::INT AS dim FROM embeddings")
def clusters_written(spark, sf):
    """Clusters as CSV, embeddings and configuration, read back and joined on cleaned ids."""
    e, path = _ids(_emb(spark, sf)), scratch(spark, "clusters")
    runs.write_clusters(e, e, path, {"method": "kmeans", "k": 10})
    c = runs.read_clusters(spark, f"{path}/clusters.csv").withColumn("map_id", F.concat("map_id", F.lit(".0")))
    return runs.clustered_embeddings(spark.read.parquet(f"{path}/embeddings.parquet"), c).select("map_id", "cluster", F.size("embedding").alias("dim"))


@query("embedding_chunks", f"SELECT vec_id::VARCHAR AS map_id, {r('embedding[1]::DOUBLE')} AS first FROM embeddings WHERE vec_id % 11 <> 10")
def embedding_chunks(spark, sf):
    """Maps embedded in chunks, stopped after the first and resumed; maps without an embedding are passed over."""
    e, path = _ids(_emb(spark, sf)), scratch(spark, "chunks")
    calls = []

    def embed(part):
        calls.append(1)
        if len(calls) == 2:
            raise InterruptedError
        return part.filter(F.col("map_id").cast("bigint") % 11 != 10)

    every = max(1, math.ceil(e.count() / 4))
    try:
        runs.embed_in_chunks(e, e, path, embed, every)
    except InterruptedError:
        runs.embed_in_chunks(e, e, path, embed, every)
    if len(calls) > 1 + math.ceil(e.count() / every):
        raise AssertionError("a chunk was made again")
    return runs.read_chunks(spark, path).select("map_id", R(F.element_at("embedding", 1).cast("double")).alias("first"))


@query("run_artefacts", f"""SELECT feature, {r('median(v)', 4)} AS median, {r('avg(v)', 4)} AS mean, {r('stddev_pop(v)', 4)} AS std, '/data' AS root, 4 AS n_features
FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem" for c in LINE)}) GROUP BY feature""")
def run_artefacts(spark, sf):
    """Feature list, standardizer and configuration of a run, read back from its folder."""
    path = scratch(spark, "run")
    runs.write_run(spark, path, list(LINE), V.fit_standardizer(table(spark, sf, "lineitem"), LINE), {"dataset_root": "/data", "k": 10})
    got = runs.load_run(spark, path)
    rows = [(f, *(float(got["preprocess"][n][k]) for n in ("median", "mean", "std")), runs.dataset_root(spark, path), len(got["features"])) for k, f in enumerate(got["features"])]
    d = spark.createDataFrame(rows, "feature string, median double, mean double, std double, root string, n_features int")
    return d.select("feature", *[R(F.col(c), 4).alias(c) for c in ("median", "mean", "std")], "root", "n_features")


@query("tag_summary_written", f"WITH {ENRICHED_ALL_SQL} SELECT cluster, count(*) AS rows_csv, least(count(*), 5) AS rows_json FROM enriched GROUP BY cluster")
def tag_summary_written(spark, sf):
    d, path = T.enrichment(_members(spark, sf), _rich_tags(spark, sf)), scratch(spark, "tags")
    sinks.write_tag_summary(d, path, 5)
    a = spark.read.csv(f"{path}/cluster_tag_summary.csv", header=True).groupBy(F.col("cluster").cast("int").alias("cluster")).agg(F.count("*").alias("rows_csv"))
    b = spark.read.schema("cluster int, tags array<struct<tag:string>>").json(f"{path}/cluster_tag_summary.jsonl").select(F.col("cluster").alias("c"), F.size("tags").cast("bigint").alias("rows_json"))
    return a.join(b, F.col("cluster") == F.col("c")).drop("c")


VIEW_SQL = """e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id::VARCHAR AS map_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS cluster FROM embeddings),
m AS (SELECT p_partkey::VARCHAR AS map_id, p_size / 3e0 AS star, p_size % 11 AS hp, CASE WHEN p_size % 3 > 0 THEN p_size % 9 END AS od, p_size % 7 AS cs, p_size % 10 AS ar, p_retailprice / 5 AS bpm, p_size * 10 AS length,
  CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS known, p_brand AS creator, p_type AS title FROM part WHERE p_partkey % 5 < 4),
v AS (SELECT pos, e.map_id, x, y, z, cluster, (pos % 4 = 0)::INT AS is_labeled, coalesce(known, -1) AS ranked, star, hp, od, cs, ar, bpm, length, coalesce(title, e.map_id) AS hover, coalesce(creator, '') AS creator FROM e LEFT JOIN m USING (map_id))"""


def _points(spark, sf):
    """Embeddings as points and parts as their metadata; four of five have any, every fourth is labelled."""
    e = V.checked_small(_emb(spark, sf).select(F.min("vec_id").alias("first")))  # one row
    e = _emb(spark, sf).crossJoin(e).select((F.col("vec_id") - F.col("first")).alias("pos"), F.col("vec_id").cast("string").alias("map_id"), *[F.element_at("embedding", k).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))], F.col("label").alias("cluster"), F.lit(100).alias("alpha"))
    p, s = F.col("p_partkey"), F.col("p_size")
    m = table(spark, sf, "part").filter("p_partkey % 5 < 4").select(
        p.cast("string").alias("map_id"), (s / 3.0).alias("star"), (s % 11).alias("hp"), F.when(s % 3 > 0, s % 9).alias("od"), (s % 7).alias("cs"), (s % 10).alias("ar"), (F.col("p_retailprice") / 5).alias("bpm"), (s * 10).alias("length"),
        F.when(p % 3 == 0, "Approved").when(p % 3 == 1, "graveyard").otherwise(" ").alias("status"), F.lit(None).cast("string").alias("artist"), F.col("p_type").alias("title"), F.lit("").alias("version"), F.col("p_brand").alias("creator"))
    return viewer.points_table(e, m, e.filter("pos % 4 = 0").select("map_id"))


def _exported(spark, sf):
    path = scratch(spark, "viewer")
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "cluster int, text string")
    return path, viewer.export_viewer(_points(spark, sf), names, path, lods={"low": 100, "mid": 200, "high": 400}, contours={"star": [[0, 1, 2, 3]]})


@query("viewer_points", f"WITH {VIEW_SQL} SELECT pos, map_id, cluster, is_labeled, {r('x', 4)} AS x, {r('z', 4)} AS z, {r('star', 4)} AS star, ranked, od::DOUBLE AS od, {r('bpm', 3)} AS bpm, hover, creator FROM v")
def viewer_points(spark, sf):
    """The export's points, ids and hover texts, read back line by line."""
    path, _ = _exported(spark, sf)
    fields = "pos long, x double, y double, z double, map_id string, cluster int, is_labeled int, star double, ranked int, od double, bpm double"
    p = spark.read.schema(fields).json(f"{path}/points3d.jsonl")
    h = spark.read.schema("pos long, hover string, creator string").json(f"{path}/map_hover.jsonl")
    j = p.join(h, "pos")
    return j.select("pos", "map_id", "cluster", "is_labeled", R(F.col("x"), 4).alias("x"), R(F.col("z"), 4).alias("z"), R(F.col("star"), 4).alias("star"), "ranked", "od", R(F.col("bpm"), 3).alias("bpm"), "hover", "creator")


@query("viewer_binary", f"WITH {VIEW_SQL} SELECT count(*) AS n, count(star) AS stars, {r('sum(cluster + is_labeled + ranked)', 2)} AS whole, {r('sum(length::DOUBLE)', 1)} AS length FROM v")
def viewer_binary(spark, sf):
    """The packed points of all files: rows, known values and sums."""
    import numpy as np

    path, meta = _exported(spark, sf)
    stride = meta["binary_points_stride"]

    def unpack(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                x = np.frombuffer(content, "<f4").reshape(-1, stride).astype(float)
                yield pd.DataFrame({"star": x[:, 5], "whole": x[:, 2] + x[:, 3] + x[:, 6], "length": x[:, 12]})

    x = spark.read.format("binaryFile").option("pathGlobFilter", "points-*.f32").load(f"{path}/points.f32").select("content").mapInPandas(unpack, "star double, whole double, length double")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return x.agg(F.count("*").alias("n"), F.count(known("star")).alias("stars"), R(F.sum("whole"), 2).alias("whole"), R(F.sum(known("length")), 1).alias("length"))


@query("viewer_labels", f"""WITH {VIEW_SQL} SELECT cluster, CASE cluster WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'c' || cluster END AS text, count(*) AS n, {r('avg(x)')} AS x,
 {r('avg(z) / sqrt(avg(x) * avg(x) + avg(y) * avg(y) + avg(z) * avg(z))', 5)} AS sz FROM v GROUP BY cluster""")
def viewer_labels(spark, sf):
    path, _ = _exported(spark, sf)
    flat, round_ = files.read_json(spark, f"{path}/labels.json"), files.read_json(spark, f"{path}/labels3d.json")
    d = spark.createDataFrame([(a["cluster"], a["text"], a["n"], a["x"], b["z"]) for a, b in zip(flat, round_)], "cluster int, text string, n long, x double, sz double")
    return d.select("cluster", "text", "n", R(F.col("x")).alias("x"), R(F.col("sz"), 5).alias("sz"))


@query("viewer_summary", f"""WITH {VIEW_SQL}, s AS (SELECT count(*) AS n, sum(is_labeled) AS lab, count(*) FILTER (ranked >= 0) AS rk, count(star) AS st, count(od) AS od, count(length) AS le FROM v)
SELECT * FROM (SELECT unnest(['n_points', 'labeled_count', 'ranked_known_count', 'star_known_count', 'od_known_count', 'length_known_count', 'lod_low', 'lod_mid', 'lod_high', 'contour_total_segments', 'stride_3d']) AS name,
 unnest([n, lab, rk, st, od, le, least(n, 1000), least(n, 1000), least(n, 1000), 1, 14])::BIGINT AS value FROM s)""")
def viewer_summary(spark, sf):
    path, _ = _exported(spark, sf)
    m = files.read_json(spark, f"{path}/meta.json")
    lods = spark.read.parquet(f"{path}/lods.parquet").groupBy("lod").agg(F.count_distinct("pos").alias("n")).collect()
    rows = [(k, m[k]) for k in ("n_points", "labeled_count", "ranked_known_count", "star_known_count", "od_known_count", "length_known_count", "contour_total_segments")]
    rows += [(f"lod_{x['lod']}", x["n"]) for x in lods] + [("stride_3d", m["binary_points3d_stride"])]
    return spark.createDataFrame(rows, "name string, value long")


@query("viewer_stats", f"""WITH {VIEW_SQL}, g AS (SELECT cluster, avg(star) AS mu, stddev_pop(star) AS sd FROM v GROUP BY cluster)
SELECT cluster, {r('avg(star) FILTER (sd <= 1e-6 OR abs(star - mu) <= 25e-1 * sd)', 5)} AS star FROM v JOIN g USING (cluster) GROUP BY cluster""")
def viewer_stats(spark, sf):
    path, _ = _exported(spark, sf)
    got = files.read_json(spark, f"{path}/cluster_stats.json")
    return spark.createDataFrame([(int(k), v["star"]) for k, v in got.items()], "cluster int, star double").select("cluster", R(F.col("star"), 5).alias("star"))


@query("viewer_filter", f"WITH {VIEW_SQL} SELECT map_id FROM v WHERE ranked = 1 AND star >= 4 AND bpm BETWEEN 180 AND 250 AND od BETWEEN 1 AND 8")
def viewer_filter(spark, sf):
    """Ranked points within ranges; the upper end of star is open, an unknown od fails."""
    return viewer.visible(_points(spark, sf), ranked="ranked", ranges={"star": (4, 15), "bpm": (180, 250), "od": (1, 8)}).select("map_id")


@query("viewer_labelled", f"WITH {VIEW_SQL} SELECT map_id FROM v WHERE is_labeled = 1 AND (od IS NULL OR od >= 3)")
def viewer_labelled(spark, sf):
    return viewer.visible(_points(spark, sf), labelled_only=True, ranges={"od": (3, 10)}, keep_unknown=True).select("map_id")


@query("viewer_search", f"WITH {VIEW_SQL}, c AS (SELECT min(creator) AS c FROM v WHERE creator <> '') SELECT map_id, cluster FROM v, c WHERE creator = c")
def viewer_search(spark, sf):
    p = _points(spark, sf)
    name = p.filter("creator <> ''").agg(F.min("creator")).first()[0] or ""
    return viewer.search(p, mapper=f" {name.upper()}").select("map_id", "cluster")


@query("user_top", """WITH s AS (SELECT o_orderkey % 400 AS id, min(-o_totalprice) AS rank FROM orders WHERE o_custkey % 50 = 7 GROUP BY 1), b AS (SELECT id FROM s ORDER BY rank, id::VARCHAR LIMIT 20)
SELECT vec_id::VARCHAR AS map_id FROM embeddings WHERE vec_id IN (SELECT id FROM b)""")
def user_top(spark, sf):
    """The points of a user's twenty best scores; the user is named by name."""
    o = table(spark, sf, "orders").filter("o_custkey % 50 = 7").groupBy((F.col("o_orderkey") % 400).cast("string").alias("map_id")).agg(F.min(-F.col("o_totalprice")).alias("rank"))
    s = o.select(F.lit(7).alias("user_id"), F.lit("Seven").alias("user_name"), "map_id", "rank")
    return viewer.top_of_user(s, _ids(_emb(spark, sf)), "seven", 20).select("map_id")


@query("patched_clusters", f"""WITH {CENT_SQL}, s AS (SELECT vec_id, label, {DOT.format(a='embedding', b='centroid')} / (sqrt({DOT.format(a='embedding', b='embedding')}) + 1e-9) / (sqrt({DOT.format(a='centroid', b='centroid')}) + 1e-9) AS sim FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 7 = 0), c),
n AS (SELECT vec_id, arg_max(label, (sim, -label)) AS cluster FROM s GROUP BY vec_id) SELECT vec_id, coalesce(n.cluster, label) AS cluster FROM embeddings LEFT JOIN n USING (vec_id)""")
def patched_clusters(spark, sf):
    """Given ids are assigned their nearest centroid and replace their rows; the others stay."""
    e = _emb(spark, sf)
    new = V.nearest_centroid(e.filter("vec_id % 7 = 0"), "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label").select("vec_id", F.col("label").alias("cluster"))
    return T.upsert(e.select("vec_id", F.col("label").alias("cluster")), new, ["vec_id"])


def _inertia(spark, rows, cents):
    """Rows, clusters used, and whether each row's cluster is the nearest of all centres."""
    near = C.assigned(rows.drop("cluster"), "embedding", cents)[0].select("vec_id", F.col("cluster").alias("best"))
    j = rows.select("vec_id", "cluster").join(near, "vec_id")
    return j.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("cluster") == F.col("best")).alias("nearest"))


@query("kmeans_is_nearest", "SELECT count(*) AS n, 10::BIGINT AS clusters, count(*) AS nearest FROM embeddings")
def kmeans_is_nearest(spark, sf):
    rows, cents, _ = C.kmeans(_emb(spark, sf), "embedding", 10)
    return _inertia(spark, rows, cents)


@query("minibatch_is_nearest", "SELECT count(*) AS n, 10::BIGINT AS clusters, count(*) AS nearest FROM embeddings")
def minibatch_is_nearest(spark, sf):
    rows, cents, _ = C.minibatch_kmeans(_emb(spark, sf), "vec_id", "embedding", 10)
    return _inertia(spark, rows, cents)


@query("sweep_of_both", "SELECT a.algorithm, k, count(*) AS n_points, 64 AS dim, true AS falls, true AS near_best FROM embeddings, (SELECT unnest(['kmeans', 'minibatch']) AS algorithm) a, (SELECT unnest([2, 4, 8]) AS k) GROUP BY a.algorithm, k")
def sweep_of_both(spark, sf):
    """Inertias of both algorithms: they fall with k, and mini-batches stay within a tenth of the whole."""
    e = _emb(spark, sf)
    both = [C.elbow(e, "embedding", [2, 4, 8], 2, a, "vec_id") for a in C.ALGORITHMS]
    j = both[0].select("k", F.col("inertia").alias("whole")).join(both[0].unionByName(both[1]), "k")
    return j.select("algorithm", "k", "n_points", "dim", (F.coalesce("delta_abs", F.lit(1.0)) > 0).alias("falls"), (F.col("inertia") <= 1.1 * F.col("whole")).alias("near_best"))


@query("elbow_written", "SELECT unnest([2, 3, 5]) AS k, unnest([100e0, 60e0, 59e0]) * (SELECT count(*) FROM embeddings) AS inertia, unnest([NULL, 40e0, 1e0]) * (SELECT count(*) FROM embeddings) AS delta_abs")
def elbow_written(spark, sf):
    """A sweep of given inertias with its drops, written as CSV and JSON and read back."""
    n, path = _emb(spark, sf).count(), scratch(spark, "elbow")
    e = C.with_drops(spark.createDataFrame([(2, 100.0 * n), (3, 60.0 * n), (5, 59.0 * n)], "k int, inertia double"))
    runs.write_elbow(e, path, C.suggested_k(e).first()[0])
    got = files.read_json(spark, f"{path}/elbow_k.json")
    if got["k_values"] != [2, 3, 5] or got["suggested_k"] != 5:
        raise AssertionError(got)
    return spark.read.schema("k int, inertia double, delta_abs double, delta_pct double").csv(f"{path}/elbow_k.csv", header=True).select("k", "inertia", "delta_abs")


@query("dendrogram_cuts", "SELECT k, count(*) AS n, k::BIGINT AS clusters, true AS nested FROM embeddings, (SELECT unnest([3, 5]) AS k) GROUP BY k")
def dendrogram_cuts(spark, sf):
    """A saved dendrogram cut at 3 and 5: all rows, as many clusters, and those of 5 within those of 3."""
    path, e = scratch(spark, "linkage"), _emb(spark, sf)
    pre, cents, _ = C.kmeans(e, "embedding", 24)
    C.save_linkage(e, C.linkage(cents), [str(i) for i in range(len(cents))], path)
    of = {k: C.recut(spark, path, k).select("name", F.col("cluster").alias(f"c{k}")) for k in (3, 5)}
    j = pre.select(F.col("cluster").cast("string").alias("name")).join(of[3], "name").join(of[5], "name")
    nested = j.groupBy("c5").agg(F.count_distinct("c3").alias("n")).agg(F.max("n")).first()[0] == 1
    return j.select(F.explode(F.array(F.struct(F.lit(3).alias("k"), F.col("c3").alias("c")), F.struct(F.lit(5).alias("k"), F.col("c5").alias("c")))).alias("x")).groupBy("x.k").agg(F.count("*").alias("n"), F.count_distinct("x.c").alias("clusters")).withColumn("nested", F.lit(nested))


@query("axes_of_pca", f"WITH u AS (SELECT vec_id, unnest(range(1, 65)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings), t AS (SELECT p, var_pop(v) AS w FROM u GROUP BY p) SELECT {r('sum(w)', 5)} AS variance, 0e0 AS mixed, 0e0 AS mean FROM t")
def axes_of_pca(spark, sf):
    """All 64 axes: their variances add up to that of the vectors, they don't correlate, and their means are 0."""
    p = V.pca(_emb(spark, sf), "vec_id", "embedding", 64)
    a = p.agg(sum(F.var_pop(f"pc{k}") for k in range(1, 65)).alias("v"), F.greatest(*[F.abs(F.covar_pop(f"pc{i}", f"pc{j}")) for i, j in ((1, 2), (1, 3), (2, 3), (7, 40))]).alias("c"), F.greatest(*[F.abs(F.avg(f"pc{k}")) for k in (1, 2, 64)]).alias("m"))
    return a.select(R(F.col("v"), 5).alias("variance"), R(F.col("c"), 8).alias("mixed"), R(F.col("m"), 8).alias("mean"))


@query("mesh_counts", "SELECT n::INT AS n, (10 * 4 ** n + 2)::BIGINT AS vertices, (20 * 4 ** n)::BIGINT AS faces, (30 * 4 ** n)::BIGINT AS edges, true AS on_sphere FROM range(1, 5) q(n)")
def mesh_counts(spark, sf):
    out = None
    for n in range(1, 5):
        v, f, e = M.mesh_tables(spark, n)
        far = v.agg(F.count("*"), F.max(F.abs(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) - 1))).first()
        row = spark.createDataFrame([(n, far[0], f.count(), e.count(), far[1] < 1e-9)], "n int, vertices long, faces long, edges long, on_sphere boolean")
        out = row if out is None else out.union(row)
    return out


@query("strain_series", "WITH s AS (SELECT user_id AS map_id, (epoch_us(ts) // 1000 // 400) * 400 AS bucket_ms, max(value) AS aim FROM events GROUP BY ALL) SELECT e.event_id, s.aim FROM events e LEFT JOIN s ON s.map_id = e.user_id AND s.bucket_ms = (epoch_us(e.ts) // 1000 // 400) * 400")
def strain_series(spark, sf):
    """A series of strains in buckets of 400 ms, looked up by each event's time."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("map_id"), "event_id", "value", F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("t_ms"))
    bucket = F.expr("(t_ms div 400) * 400")
    s = e.groupBy("map_id", bucket.alias("bucket_ms")).agg(F.max("value").alias("aim"))
    return e.withColumn("bucket_ms", bucket).join(s, ["map_id", "bucket_ms"], "left").select("event_id", "aim")

