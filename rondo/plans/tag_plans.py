"""Queries of tag enrichment, cluster statistics, set operations and samples."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rounded as R
from ..operators import sampling, tags
from .adapters import r
from .registry import query, table

TAGS_SQL = """tags AS (SELECT DISTINCT o_custkey AS map_id, p_brand || ' ' || p_type AS tag FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
members AS (SELECT c_custkey AS map_id, c_nationkey AS cluster FROM customer)"""
ENRICHED_ALL_SQL = TAGS_SQL + """, t AS (SELECT * FROM members JOIN tags USING (map_id)), c AS (SELECT cluster, tag, count(*) AS n FROM t GROUP BY ALL),
z AS (SELECT cluster, count(DISTINCT map_id) AS size FROM t GROUP BY cluster), g AS (SELECT tag, sum(n) AS n_all FROM c GROUP BY tag),
e AS (SELECT c.cluster, size, c.tag, n, n / size::DOUBLE AS frac, n_all / (SELECT count(DISTINCT map_id) FROM t)::DOUBLE AS frac_all,
 row_number() OVER (PARTITION BY c.cluster ORDER BY n DESC, c.tag) AS rank FROM c JOIN z USING (cluster) JOIN g ON c.tag = g.tag),
enriched AS (SELECT *, ln((frac + 1e-9) / (frac_all + 1e-9)) AS enrichment FROM e WHERE rank <= 10)"""


def _members(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("map_id"), F.col("c_nationkey").alias("cluster"))


def _rich_tags(spark, sf):
    """Brand and type of all parts that a customer ordered: sparse tags from all line items."""
    o, l, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    j = o.join(l, o.o_orderkey == l.l_orderkey).join(p, l.l_partkey == p.p_partkey)
    return j.select(F.col("o_custkey").alias("map_id"), F.concat_ws(" ", "p_brand", "p_type").alias("tag")).distinct()


@query("tag_enrichment_all", f"WITH {ENRICHED_ALL_SQL} SELECT cluster, size AS tagged, tag, n AS tag_count, {r('frac')} AS frac, {r('frac_all')} AS frac_all, {r('enrichment')} AS enrichment FROM enriched")
def tag_enrichment_all(spark, sf):
    d = tags.enrichment(_members(spark, sf), _rich_tags(spark, sf))
    return d.select("cluster", "tagged", "tag", "tag_count", *[R(F.col(c)).alias(c) for c in ("frac", "frac_all", "enrichment")])


@query("cluster_best_tags_all", f"""WITH {ENRICHED_ALL_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {r('enrichment', 9)} DESC, n DESC, tag) AS k FROM enriched)
SELECT cluster, string_agg(tag, ', ' ORDER BY k) AS label FROM b WHERE k <= 2 GROUP BY cluster""")
def cluster_best_tags_all(spark, sf):
    d = tags.enrichment(_members(spark, sf), _rich_tags(spark, sf)).withColumn("enrichment", R(F.col("enrichment"), 9))
    return tags.best_tags(d, 2)


@query("cluster_top_labels", """WITH w AS (SELECT c_nationkey AS cluster, CASE o_orderstatus WHEN 'F' THEN 'genre' WHEN 'O' THEN 'pattern' ELSE 'other' END AS category, o_orderpriority AS name, count(*) AS w
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cluster, category ORDER BY w DESC, lower(name), name) AS rank FROM w),
p AS (SELECT cluster, string_agg(name, ' / ' ORDER BY rank) FILTER (category = 'genre' AND rank <= 2) AS g, string_agg(name, ' / ' ORDER BY rank) FILTER (category = 'pattern' AND rank <= 2) AS p,
 string_agg(name, ' / ' ORDER BY rank) FILTER (category = 'other' AND rank <= 1) AS o FROM k GROUP BY cluster)
SELECT cluster, 'c' || cluster || ': ' || coalesce(g, '-') || ' | ' || coalesce(p, '-') || ' | ' || coalesce(o, '-') AS name FROM p""")
def cluster_top_labels(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    w = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("cluster"), F.when(F.col("o_orderstatus") == "F", "genre").when(F.col("o_orderstatus") == "O", "pattern").otherwise("other").alias("category"),
        F.col("o_orderpriority").alias("name"), F.lit(1).alias("weight"))
    return tags.display_names(w, {"genre": 2, "pattern": 2, "other": 1})


@query("cluster_details", """WITH m AS (SELECT source AS cluster, doc_id AS map_id FROM documents), l AS (SELECT doc_id AS map_id, unnest(['q' || quality, 't' || toxic]) AS tag FROM labels),
b AS (SELECT map_id, list_sort(list_distinct(list(tag))) AS tags FROM l GROUP BY map_id), j AS (SELECT m.*, tags FROM m LEFT JOIN b USING (map_id))
SELECT cluster, count(*) AS n_maps, count(tags) AS n_labeled, len(list_distinct(flatten(coalesce(list(tags) FILTER (tags IS NOT NULL), [])))) AS n_tags,
 coalesce(string_agg(map_id::VARCHAR || '=' || array_to_string(tags, '+'), ';' ORDER BY map_id::VARCHAR) FILTER (tags IS NOT NULL), '') AS labeled_maps FROM j GROUP BY cluster""")
def cluster_details(spark, sf):
    m = table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.col("doc_id").alias("map_id"))
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("map_id"), F.explode(F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string")))).alias("tag"))
    d = tags.cluster_details(m, l)
    text = F.array_join(F.transform("labeled_maps", lambda x: F.concat(x["map_id"], F.lit("="), F.array_join(x["tags"], "+"))), ";")
    return d.select("cluster", "n_maps", "n_labeled", F.col("n_tags").cast("bigint").alias("n_tags"), text.alias("labeled_maps"))


@query("trimmed_cluster_means", f"""WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, {r('avg(l_extendedprice) FILTER (sd <= 1e-6 OR abs(l_extendedprice - mu) <= 15e-1 * sd)', 4)} AS trimmed, count(*) FILTER (sd <= 1e-6 OR abs(l_extendedprice - mu) <= 15e-1 * sd) AS kept FROM lineitem JOIN g USING (l_suppkey) GROUP BY l_suppkey""")
def trimmed_cluster_means(spark, sf):
    return tags.trimmed_means(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", 1.5).select("l_suppkey", R(F.col("trimmed"), 4).alias("trimmed"), "kept")


@query("auto_range", f"""WITH g AS (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, count(l_extendedprice) AS known, count(*) AS n FROM lineitem)
SELECT {r('CASE WHEN b > a THEN a ELSE mn END', 4)} AS lo, {r('CASE WHEN b > a THEN b WHEN mx > mn THEN mx ELSE mn + 1 END', 4)} AS hi, known, n FROM g""")
def auto_range(spark, sf):
    d = tags.auto_range(table(spark, sf, "lineitem"), "l_extendedprice", 0.02, 0.98)
    return d.select(R(F.col("lo"), 4).alias("lo"), R(F.col("hi"), 4).alias("hi"), "known", "n")


@query("clamped_range", f"""WITH g AS (SELECT quantile_cont(l_quantity * 7, 0.02) AS a, quantile_cont(l_quantity * 7, 0.98) AS b FROM lineitem), c AS (SELECT least(greatest(a, 30), 280) AS lo, least(greatest(b, 60), 300) AS hi FROM g)
SELECT {r('lo', 4)} AS lo, {r('greatest(hi, lo + 10)', 4)} AS hi FROM c""")
def clamped_range(spark, sf):
    d = tags.clamped_range(table(spark, sf, "lineitem").select((F.col("l_quantity") * 7).alias("v")), "v")
    return d.select(R(F.col("lo"), 4).alias("lo"), R(F.col("hi"), 4).alias("hi"))


@query("largest_clusters", "SELECT c_nationkey AS cluster, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, cluster LIMIT 5")
def largest_clusters(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(5)


@query("label_anchors", f"WITH a AS (SELECT label, avg(embedding[1]) AS x, avg(embedding[2]) AS y, avg(embedding[3]) AS z FROM embeddings GROUP BY label) SELECT label, {r('x')} AS x, {r('y')} AS y, {r('x / sqrt(x * x + y * y + z * z)')} AS sx FROM a")
def label_anchors(spark, sf):
    a = table(spark, sf, "embeddings").groupBy("label").agg(*[F.avg(F.element_at("embedding", k).cast("double")).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return a.select("label", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"), R(F.col("x") / n).alias("sx"))


@query("upsert_keep_last", """WITH b AS (SELECT conv_id, turn, role, text, 0 AS s FROM conversations UNION ALL SELECT conv_id, turn, role, 'new', 1 FROM conversations WHERE turn % 2 = 0)
SELECT conv_id, turn, role, text FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY s DESC, text) = 1""")
def upsert_keep_last(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    return tags.upsert(c, c.filter("turn % 2 = 0").withColumn("text", F.lit("new")), ["conv_id", "turn", "role"])


@query("resume_antijoin", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(done, "o_custkey", "left_anti").select("o_orderkey")


@query("ghost_ids", "SELECT c_custkey AS id, 'ghost' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT o_custkey, 'known' FROM orders WHERE o_orderstatus = 'P' ORDER BY 1")
def ghost_ids(spark, sf):
    logged = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    disk = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    ghosts = logged.join(disk, "id", "left_anti").withColumn("state", F.lit("ghost"))
    return ghosts.union(disk.filter("o_orderstatus = 'P'").select("id", F.lit("known").alias("state"))).distinct().orderBy("id")


@query("semi_ids", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_ids(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("set_algebra", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'only', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def set_algebra(spark, sf):
    o = table(spark, sf, "orders")
    f, b = (o.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO")
    return f.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).union(f.subtract(b).agg(F.lit("only"), F.count("*")))


@query("numeric_aware_sort_all", "SELECT row_number() OVER (ORDER BY try_cast(s AS BIGINT) NULLS LAST, s) AS pos, s FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_partkey ELSE p_partkey::VARCHAR END AS s FROM part)")
def numeric_aware_sort_all(spark, sf):
    k = F.col("p_partkey").cast("string")
    s = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("x"), k)).otherwise(k).alias("s"))
    return sampling.numeric_order(s, "s")


H = "substr(md5({k}::VARCHAR || ':2025'), 1, 15)"


@query("seeded_sample", f"SELECT o_orderkey FROM orders ORDER BY {H.format(k='o_orderkey')}, o_orderkey LIMIT 300")
def seeded_sample(spark, sf):
    return sampling.exact_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 300)


@query("capped_groups", f"SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H.format(k='o_orderkey')}, o_orderkey) <= 64")
def capped_groups(spark, sf):
    return sampling.capped_groups(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")


@query("lod_prefixes", f"WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {H.format(k='o_orderkey')}, o_orderkey) AS n FROM orders) SELECT o_orderkey, CASE WHEN n <= 50 THEN 0 WHEN n <= 200 THEN 1 ELSE 2 END AS lod FROM k WHERE n <= 500")
def lod_prefixes(spark, sf):
    return sampling.lod_levels(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (50, 200, 500))


@query("id_batches", "SELECT c_custkey, floor((row_number() OVER (PARTITION BY c_custkey // 50000 ORDER BY c_custkey) - 1) / 50)::BIGINT AS batch FROM customer")
def id_batches(spark, sf):
    return sampling.batches(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("completeness_reasons", """WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS d FROM lineitem GROUP BY l_orderkey),
c AS (SELECT CASE WHEN l.n IS NULL THEN 'missing_lines' WHEN c_custkey IS NULL THEN 'missing_customer' WHEN o_totalprice < 20000 THEN 'low_total' WHEN l.n < 3 THEN 'few_lines' WHEN d > 0.095 THEN 'odd_discount' ELSE 'OK' END AS reason
 FROM orders LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey) SELECT reason, count(*) AS n FROM c GROUP BY reason""")
def completeness_reasons(spark, sf):
    from ..operators.quality import first_reason

    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_discount").alias("d"))
    o = table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [("missing_lines", F.col("n").isNull()), ("missing_customer", F.col("c_custkey").isNull()), ("low_total", F.col("o_totalprice") < 20000), ("few_lines", F.col("n") < 3), ("odd_discount", F.col("d") > 0.095)]
    return o.select(first_reason(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("reason_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def reason_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("point_filter", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_retailprice >= 1000 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def point_filter(spark, sf):
    p = table(spark, sf, "part").filter("p_size between 5 and 20 and p_retailprice >= 1000")
    return p.join(table(spark, sf, "lineitem").filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("ranked_meta_join", """SELECT o_orderkey, coalesce(c_acctbal, -1e0) AS acct, (lower(trim(o_orderpriority)) IN ('ranked', 'approved', 'qualified'))::INT::DOUBLE AS ranked, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey""")
def ranked_meta_join(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    j = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_acctbal", F.lit(-1.0)).alias("acct"), S.ranked_flag(F.col("o_orderpriority")).alias("ranked"), F.col("c_custkey").isNotNull().alias("known"))
