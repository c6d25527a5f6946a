"""Queries of vectors, clustering, densities and contours."""

from pyspark.sql import functions as F

from ..functions.scalars import rounded as R
from ..operators import clustering as C
from ..operators import density as D
from ..operators import vectors as V
from .adapters import r
from .registry import query, table

DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


CENT_SQL = """u AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, pos, avg(v) AS v FROM u GROUP BY ALL),
c AS (SELECT label, list(v ORDER BY pos) AS centroid FROM m GROUP BY label)"""


@query("centroids", f"WITH {CENT_SQL} SELECT label, pos - 1 AS pos, {r('v')} AS v FROM m")
def centroids(spark, sf):
    c = V.centroids(_emb(spark, sf), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p", "v")).select("label", F.col("p").cast("bigint").alias("pos"), R(F.col("v")).alias("v"))


@query("nearest_centroid", f"""WITH {CENT_SQL}, s AS (SELECT vec_id, label, {DOT.format(a='embedding', b='centroid')} / (sqrt({DOT.format(a='embedding', b='embedding')}) + 1e-9) / (sqrt({DOT.format(a='centroid', b='centroid')}) + 1e-9) AS sim FROM (SELECT vec_id, embedding FROM embeddings), c)
SELECT vec_id, arg_max(label, (sim, -label)) AS label, {r('max(sim)')} AS sim FROM s GROUP BY vec_id""")
def nearest_centroid(spark, sf):
    e = _emb(spark, sf)
    return V.nearest_centroid(e, "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label").select("vec_id", "label", R(F.col("sim")).alias("sim"))


@query("knn_join", f"""WITH p AS (SELECT q.vec_id AS q_id, b.vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))) AS dist FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0)
SELECT q_id, vec_id, {r('dist')} AS dist, row_number() OVER (PARTITION BY q_id ORDER BY {r('dist', 9)}, vec_id) AS rank FROM p QUALIFY rank <= 8""")
def knn_join(spark, sf):
    e = _emb(spark, sf)
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    return V.knn(q, "q_id", "embedding", e, "vec_id", "embedding", 8).select("q_id", "vec_id", R(F.col("dist")).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query("pairwise_infonce_all", f"""WITH v AS (SELECT vec_id // 32 AS batch, vec_id // 2 AS item, vec_id % 2 AS side, embedding AS e, sqrt({DOT.format(a='embedding', b='embedding')}) + 1e-9 AS n FROM embeddings),
j AS (SELECT a.batch, a.item, a.side, b.item AS i2, {DOT.format(a='a.e', b='b.e')} / a.n / b.n / 0.1e0 AS s FROM v a JOIN v b ON a.batch = b.batch AND (a.item <> b.item OR a.side <> b.side)),
w AS (SELECT batch, item, side, ln(sum(exp(s))) - max(s) FILTER (i2 = item) AS l FROM j GROUP BY ALL) SELECT batch, {r('avg(l)')} AS loss FROM w GROUP BY batch""")
def pairwise_infonce_all(spark, sf):
    """All embeddings; the last batch may be partial."""
    return _infonce(_emb(spark, sf))


def _infonce(e):
    p = e.withColumn("item", F.expr("vec_id div 2")).withColumn("batch", F.expr("vec_id div 32")).groupBy("batch", "item").agg(
        F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("b"))
    return V.infonce(p).select("batch", R(F.col("loss")).alias("loss"))


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FIT_SQL = f"""u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, least(greatest(CASE WHEN l_linenumber % 5 > 0 THEN {c} END, -1e6), 1e6) AS v FROM lineitem" for c in LINE)}),
u2 AS (SELECT feature, CASE WHEN v IS NOT NULL AND v > -1e6 THEN v END AS v FROM u),
md AS (SELECT feature, coalesce(median(v), 0e0) AS median FROM u2 GROUP BY feature), fit AS (SELECT feature, median, avg(coalesce(v, median)) AS mean, stddev_pop(coalesce(v, median)) AS std FROM u2 JOIN md USING (feature) GROUP BY ALL)"""


def _gappy(spark, sf):
    return table(spark, sf, "lineitem").withColumns({c: F.when(F.col("l_linenumber") % 5 > 0, F.col(c)) for c in LINE})


@query("standardize_fit", f"WITH {FIT_SQL} SELECT feature, {r('median', 4)} AS median, {r('mean', 4)} AS mean, {r('CASE WHEN std <= 1e-8 THEN 1 ELSE std END', 4)} AS std FROM fit")
def standardize_fit(spark, sf):
    return V.fit_standardizer(_gappy(spark, sf), LINE).select("feature", *[R(F.col(c), 4).alias(c) for c in ("median", "mean", "std")])


@query("standardize_apply", f"WITH {FIT_SQL} SELECT l_orderkey, l_linenumber, " + ", ".join(f"floor(greatest(-50, least(50, (coalesce(CASE WHEN l_linenumber % 5 > 0 THEN {c} END, (SELECT median FROM fit WHERE feature = '{c}')) - (SELECT mean FROM fit WHERE feature = '{c}')) / (SELECT std FROM fit WHERE feature = '{c}'))) * 1e6 + 5e-1) / 1e6 AS {c}" for c in LINE) + " FROM lineitem")
def standardize_apply(spark, sf):
    g = _gappy(spark, sf)
    z = V.standardize(g, V.fitted_values(V.fit_standardizer(g, LINE)))
    return z.select("l_orderkey", "l_linenumber", *[R(F.col(c)).alias(c) for c in LINE])


@query("covariance_matrix_all", "WITH p AS (SELECT i, j FROM range(64) a(i), range(64) b(j) WHERE i <= j) SELECT i::INT AS i, j::INT AS j, floor(covar_pop(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) * 1e8 + 5e-1) / 1e8 AS cov FROM embeddings, p GROUP BY i, j")
def covariance_matrix_all(spark, sf):
    """All positions."""
    return V.covariance(_emb(spark, sf), "embedding").select("i", "j", R(F.col("cov"), 8).alias("cov"))


@query("pca_2d")
def pca_2d(spark, sf):
    return V.pca(_emb(spark, sf), "vec_id", "embedding", 2)


@query("sphere_3d")
def sphere_3d(spark, sf):
    return V.on_sphere(V.pca(_emb(spark, sf), "vec_id", "embedding", 3), "vec_id")


@query("kmeans_assign")
def kmeans_assign(spark, sf):
    return C.kmeans(_emb(spark, sf), "embedding", 10)[0].select("vec_id", "cluster")


@query("elbow")
def elbow(spark, sf):
    return C.elbow(_emb(spark, sf), "embedding", [2, 4, 8])


@query("elbow_deltas", "WITH e AS (SELECT label AS k, sum(embedding[1]::DOUBLE * embedding[1]::DOUBLE) AS inertia FROM embeddings GROUP BY label) SELECT k, floor((lag(inertia) OVER (ORDER BY k) - inertia) * 1e6 + 5e-1) / 1e6 AS delta_abs FROM e")
def elbow_deltas(spark, sf):
    from pyspark.sql import Window as W

    x = F.element_at("embedding", 1).cast("double")
    e = _emb(spark, sf).groupBy(F.col("label").alias("k")).agg(F.sum(x * x).alias("inertia"))
    return e.select("k", R(F.lag("inertia").over(W.orderBy("k")) - F.col("inertia")).alias("delta_abs"))


@query("agglomerative")
def agglomerative(spark, sf):
    return C.agglomerative(_emb(spark, sf), "vec_id", "embedding", 5, 24)


@query("recursive_agglomerative")
def recursive_agglomerative(spark, sf):
    return C.recursive_agglomerative(_emb(spark, sf), "vec_id", "embedding", 5, 4, 3)


POINTS_SQL = "p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS y, l_discount * 100 AS value FROM lineitem), rg AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)"
DENS_SQL = POINTS_SQL + """, b AS (SELECT p.*, least(floor((x - lx) / (hx - lx) * {n}), {m}) AS bx, least(floor((y - ly) / (hy - ly) * {n}), {m}) AS by_ FROM p, rg),
d AS (SELECT *, count(*) OVER (PARTITION BY bx, by_) AS density FROM b)"""


def _points(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("value"))


@query("density_2d", f"WITH {DENS_SQL.format(n=240, m=239)} SELECT l_orderkey, l_linenumber, x, y, density FROM d")
def density_2d(spark, sf):
    return D.density_2d(_points(spark, sf)).select("l_orderkey", "l_linenumber", "x", "y", "density")


@query("density_alpha", f"WITH {DENS_SQL.format(n=220, m=219)}, m AS (SELECT min(density) AS mn, max(density) AS mx FROM d) SELECT l_orderkey, l_linenumber, x, floor(35 + 210e0 * (density - mn) / (mx - mn))::INT AS alpha FROM d, m")
def density_alpha(spark, sf):
    return D.alpha(_points(spark, sf), 35.0, 210.0, 120.0, True, 220).select("l_orderkey", "l_linenumber", "x", "alpha")


@query("plot_alpha", f"WITH {DENS_SQL.format(n=220, m=219)}, m AS (SELECT min(density) AS mn, max(density) AS mx FROM d) SELECT l_orderkey, l_linenumber, y, {r('0.05e0 + 0.6e0 * (density - mn) / (mx - mn)')} AS alpha FROM d, m")
def plot_alpha(spark, sf):
    return D.alpha(_points(spark, sf), 0.05, 0.6, 0.35, False, 220).select("l_orderkey", "l_linenumber", "y", R(F.col("alpha")).alias("alpha"))


@query("density_sphere", f"""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), n AS (SELECT vec_id, a / sqrt(a * a + b * b + c * c) AS x, b / sqrt(a * a + b * b + c * c) AS y, c / sqrt(a * a + b * b + c * c) AS z FROM v),
k AS (SELECT *, least(greatest(floor((asin(least(greatest(z, -1e0), 1e0)) + 3.141592653589793e0 / 2) / 3.141592653589793e0 * 24), 0), 23) AS bi, least(greatest(floor((atan2(y, x) + 3.141592653589793e0) / (2 * 3.141592653589793e0) * 48), 0), 47) AS bj FROM n)
SELECT vec_id, {r('count(*) OVER (PARTITION BY bi, bj) / greatest(cos((bi + 5e-1) / 24 * 3.141592653589793e0 - 3.141592653589793e0 / 2) * (3.141592653589793e0 / 24) * (2 * 3.141592653589793e0 / 48), 1e-8)', 4)} AS density FROM k""")
def density_sphere(spark, sf):
    e = _emb(spark, sf).select("vec_id", *[F.element_at("embedding", k + 1).cast("double").alias(c) for k, c in enumerate("abc")])
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    p = e.select("vec_id", *[(F.col(s) / n).alias(t) for s, t in zip("abc", "xyz")])
    return D.density_sphere(p, 24).select("vec_id", R(F.col("density"), 4).alias("density"))


GRID_SQL = POINTS_SQL + """, cells AS (SELECT floor((x - lx) / (hx - lx + 1e-12) * 39)::INT AS ix, floor((y - ly) / (hy - ly + 1e-12) * 39)::INT AS iy, least(greatest(value, 0e0), 10e0) AS v, value FROM p, rg),
w AS (SELECT ix, iy, v, (CASE WHEN 10 > 8 THEN 1 + 1.4e0 * tanh(1.6e0 * least(greatest((value - 8e0) / (15e0 - 8e0), 0e0), 1e0)) END) * (1 + 0.65e0 * pow(greatest(0e0, 3e0 - value), 1.2e0)) AS w FROM cells),
grid AS (SELECT ix, iy, sum(v * w) / sum(w) AS value FROM w GROUP BY ix, iy)"""


def _grid(spark, sf):
    w = D.boost(F.col("value"), 8.0, 1.4, 1.6, 15.0, 3.0, 0.65, 1.2)
    return D.weighted_grid(_points(spark, sf), w, 40, 0.0, 10.0)


@query("boosted_grid", f"WITH {GRID_SQL} SELECT ix, iy, {r('value', 5)} AS value FROM grid")
def boosted_grid(spark, sf):
    return _grid(spark, sf).select("ix", "iy", R(F.col("value"), 5).alias("value"))


def _ask(src):
    return f"""SELECT a.ix, a.iy, avg(b.value) AS m FROM {src} a JOIN range(-1, 2) o(dx) ON true JOIN range(-1, 2) q(dy) ON dx <> 0 OR dy <> 0
 JOIN {src} b ON b.ix = least(greatest(a.ix + dx, 0), 39) AND b.iy = least(greatest(a.iy + dy, 0), 39) GROUP BY a.ix, a.iy"""


FIELD_SQL = GRID_SQL + f""", f0 AS (SELECT i::INT AS ix, j::INT AS iy, value FROM range(40) a(i) JOIN range(40) b(j) ON true LEFT JOIN grid ON ix = i AND iy = j),
n1 AS ({_ask('f0')}), f1 AS (SELECT f0.ix, f0.iy, coalesce(value, m) AS value FROM f0 JOIN n1 ON f0.ix = n1.ix AND f0.iy = n1.iy),
n2 AS ({_ask('f1')}), f2 AS (SELECT f1.ix, f1.iy, coalesce(value, m) AS value FROM f1 JOIN n2 ON f1.ix = n2.ix AND f1.iy = n2.iy),
bx AS (SELECT ix, iy, (coalesce(lag(value) OVER w, value) + value + coalesce(lead(value) OVER w, value)) / 3 AS value FROM f2 WINDOW w AS (PARTITION BY iy ORDER BY ix)),
field AS (SELECT ix, iy, (coalesce(lag(value) OVER w, value) + value + coalesce(lead(value) OVER w, value)) / 3 AS value FROM bx WINDOW w AS (PARTITION BY ix ORDER BY iy))"""


def _field(spark, sf):
    return D.box_blur(D.fill_holes(D.dense(_grid(spark, sf), 40), 40, 2), 1)


@query("grid_fill_blur", f"WITH {FIELD_SQL} SELECT ix, iy, {r('value', 5)} AS value FROM field")
def grid_fill_blur(spark, sf):
    return _field(spark, sf).select("ix", "iy", R(F.col("value"), 5).alias("value"))


SEG_SQL = FIELD_SQL + f""", rf AS (SELECT ix, iy, {r('value', 5)} AS value FROM field), c0 AS (SELECT *, value AS a, lead(value) OVER (PARTITION BY iy ORDER BY ix) AS b, lead(value) OVER (PARTITION BY ix ORDER BY iy) AS d FROM rf),
c1 AS (SELECT *, lead(d) OVER (PARTITION BY iy ORDER BY ix) AS c FROM c0), lv AS (SELECT *, (a >= level)::INT + 2 * (b >= level)::INT + 4 * (c >= level)::INT + 8 * (d >= level)::INT AS code FROM c1, (SELECT unnest([45e-1, 5e0, 55e-1]) AS level) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL),
t(code, p, q) AS (VALUES {', '.join(f'({k}, {a}, {b})' for k, v in D.CROSSED.items() for a, b in v)}),
pt AS (SELECT lv.*, p, q, [ix + CASE WHEN a = b THEN 5e-1 ELSE (level - a) / (b - a) END, ix + 1, ix + CASE WHEN d = c THEN 5e-1 ELSE (level - d) / (c - d) END, ix] AS px,
 [iy, iy + CASE WHEN b = c THEN 5e-1 ELSE (level - b) / (c - b) END, iy + 1, iy + CASE WHEN a = d THEN 5e-1 ELSE (level - a) / (d - a) END] AS py FROM lv JOIN t ON lv.code = t.code),
seg AS (SELECT * FROM (SELECT level, {r('px[p + 1]', 4)} AS x0, {r('py[p + 1]', 4)} AS y0, {r('px[q + 1]', 4)} AS x1, {r('py[q + 1]', 4)} AS y1 FROM pt) WHERE x0 <> x1 OR y0 <> y1)"""


def _segments(spark, sf):
    return D.marching_squares(_field(spark, sf).select("ix", "iy", R(F.col("value"), 5).alias("value")), [4.5, 5.0, 5.5])


@query("marching_squares", f"WITH {SEG_SQL} SELECT level, x0, y0, x1, y1 FROM seg")
def marching_squares(spark, sf):
    return _segments(spark, sf)


@query("segment_simplify", f"""WITH {SEG_SQL}, q AS (SELECT level, {{'x': floor(x0 / 25e-2 + 5e-1) * 25e-2, 'y': floor(y0 / 25e-2 + 5e-1) * 25e-2}} AS p, {{'x': floor(x1 / 25e-2 + 5e-1) * 25e-2, 'y': floor(y1 / 25e-2 + 5e-1) * 25e-2}} AS q FROM seg),
d AS (SELECT DISTINCT level, least(p, q) AS p, greatest(p, q) AS q FROM q WHERE p <> q) SELECT level, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM d WHERE sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) >= 5e-1 QUALIFY (row_number() OVER (PARTITION BY level ORDER BY p, q) - 1) % 2 = 0""")
def segment_simplify(spark, sf):
    return D.simplify_segments(_segments(spark, sf), 0.25, 0.5, 2)
