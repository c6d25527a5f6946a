"""Level texts, tag files, ids and logs made of table rows, parsed, and compared with SQL over the same rows."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import windows as B
from ..sources import files, sinks
from ..sources import level_text as L
from ..sources import tag_files as T
from .adapters import HOUR, NOTES_SQL, notes, r
from .registry import query, scratch, table
from .window_plans import LABELS_SQL, _labelled

LEVEL_SQL = """lv AS (SELECT user_id AS u, event_id AS id, event_type AS e, json_extract(props, '$.k')::BIGINT AS k, epoch_us(ts) // 1000 - 1704067200000 AS ms, value FROM events),
ob AS (SELECT * FROM lv WHERE e <> 'signup'), tp AS (SELECT * FROM lv WHERE e = 'signup'), us AS (SELECT DISTINCT u FROM lv)"""


def _levels(spark, sf):
    """One text a user: events are hit objects, sign-ups timing lines; every fifth user has another mode, every seventh no objects."""
    e = table(spark, sf, "events").withColumn("ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000 - 1704067200000")).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    slider = F.concat_ws(",", (F.col("k") * 5).cast("string"), (F.col("k") * 3).cast("string"), F.col("ms").cast("string"), F.lit("2,0"), F.concat(F.lit("B|"), F.col("k").cast("string"), F.lit(":7|9:"), F.col("k").cast("string")), (F.col("k") % 4).cast("string"), F.col("k").cast("string"))
    plain = F.concat_ws(",", (F.col("k") * 5).cast("string"), (F.col("k") * 3).cast("string"), F.col("ms").cast("string"), F.when(F.col("event_type") == "error", "12,0").otherwise("5,0"))
    line = F.when(F.col("event_type") == "signup", F.concat_ws(",", F.col("ms").cast("string"), F.when(F.col("k") % 3 == 0, -50 - F.col("k")).otherwise(300 + F.col("k")).cast("string"), F.lit("4,1,0,100"), F.when(F.col("k") % 3 == 0, "0").otherwise("1"), F.lit("0")))
    line = line.when(F.col("event_type") == "purchase", slider).otherwise(plain)
    rows = e.groupBy(F.col("user_id").alias("u")).agg(
        *[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("event_id", line.alias("line"))))), lambda x: x["line"]), "\r\n").alias(n) for n, which in (("objects", F.col("event_type") != "signup"), ("timing", F.col("event_type") == "signup"))])
    u = F.col("u")
    text = F.concat(
        F.lit("osu file format v14\n\n[General]\nMode: "), F.when(u % 5 == 4, "3").otherwise("0"), F.lit("\nTitle: One: "), u.cast("string"), F.lit("\nEmpty:\n\n[Difficulty]\nHPDrainRate:"), (u % 11).cast("string"),
        F.lit("\nApproachRate:"), F.when(u % 3 == 0, "x").otherwise((u % 10).cast("string")), F.lit("\n\n[TimingPoints]\n"), F.col("timing"), F.lit("\nbad\n\n[HitObjects]\n"), F.when(u % 7 == 6, "").otherwise(F.col("objects")), F.lit("\n"))
    return rows.select(u.alias("map_id"), text.alias("text"))


@query("level_sections", f"""WITH {LEVEL_SQL} SELECT u AS map_id, 'General' AS section, 3::BIGINT AS n FROM us UNION ALL SELECT u, 'Difficulty', 2 FROM us
UNION ALL SELECT us.u, 'TimingPoints', 1 + count(tp.u) FROM us LEFT JOIN tp USING (u) GROUP BY us.u UNION ALL SELECT u, 'HitObjects', count(*) FROM ob WHERE u % 7 <> 6 GROUP BY u""")
def level_sections(spark, sf):
    return L.sections(_levels(spark, sf)).groupBy("map_id", "section").agg(F.count("*").alias("n"))


@query("level_key_values", f"WITH {LEVEL_SQL} SELECT u AS map_id, 'Mode' AS key, CASE WHEN u % 5 = 4 THEN '3' ELSE '0' END AS value FROM us UNION ALL SELECT u, 'Title', 'One: ' || u FROM us UNION ALL SELECT u, 'Empty', '' FROM us")
def level_key_values(spark, sf):
    return L.key_values(L.sections(_levels(spark, sf)), "General")


@query("level_difficulty", f"WITH {LEVEL_SQL} SELECT u AS map_id, (u % 11)::DOUBLE AS hp, CASE WHEN u % 3 > 0 THEN (u % 10)::DOUBLE END AS ar, NULL::DOUBLE AS cs FROM us")
def level_difficulty(spark, sf):
    d = L.difficulty(L.sections(_levels(spark, sf)))
    return d.select("map_id", F.col("HPDrainRate").alias("hp"), F.col("ApproachRate").alias("ar"), F.col("CircleSize").alias("cs"))


@query("level_timing", f"WITH {LEVEL_SQL} SELECT u AS map_id, ms AS t_ms, CASE WHEN k % 3 = 0 THEN 'sv' ELSE 'bpm' END AS kind, {r('CASE WHEN k % 3 = 0 THEN 100e0 / (50 + k) ELSE 60000e0 / (300 + k) END')} AS value FROM tp")
def level_timing(spark, sf):
    t = L.timing(L.sections(_levels(spark, sf)))
    return t.select("map_id", "t_ms", "kind", S.rounded(F.col("value")).alias("value"))


@query("level_objects", f"""WITH {LEVEL_SQL} SELECT u AS map_id, ms AS t_ms, (k * 5)::DOUBLE AS x, (k * 3)::DOUBLE AS y, CASE e WHEN 'purchase' THEN 'slider' WHEN 'error' THEN 'spinner' ELSE 'circle' END AS obj_type,
 CASE WHEN e = 'purchase' THEN 'B' END AS curve, CASE WHEN e = 'purchase' THEN greatest(1, k % 4) END::BIGINT AS slider_repeats, CASE WHEN e = 'purchase' THEN k::DOUBLE END AS slider_len,
 CASE WHEN e = 'purchase' THEN k::DOUBLE END AS fa_x, CASE WHEN e = 'purchase' THEN 9e0 END AS la_x FROM ob WHERE u % 7 <> 6""")
def level_objects(spark, sf):
    o = L.hit_objects(L.sections(_levels(spark, sf)), max_ms=1 << 40)
    return o.select("map_id", "t_ms", "x", "y", "obj_type", "curve", F.col("slider_repeats").cast("bigint").alias("slider_repeats"), "slider_len", "fa_x", "la_x")


@query("level_skip_reasons", f"""WITH {LEVEL_SQL}, c AS (SELECT u, count(*) AS n, count(*) FILTER (ms <= 3600000) AS good FROM ob WHERE u % 7 <> 6 GROUP BY u)
SELECT us.u AS map_id, CASE WHEN us.u % 5 = 4 THEN 'NON_STD_MODE' WHEN n IS NULL THEN 'NO_HITOBJECTS' WHEN good = 0 THEN 'NO_VALID_HITOBJECTS' ELSE 'OK' END AS reason FROM us LEFT JOIN c USING (u)""")
def level_skip_reasons(spark, sf):
    return L.skip_reason(_levels(spark, sf))


def _tag_files(spark, sf):
    """A file for each customer segment, in one of the three layouts, with a record for each order."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rich = F.struct((F.col("o_orderkey") % 5).alias("count"), (F.col("o_orderstatus") == "P").alias("is_negative"), F.col("o_orderstatus").alias("category"))
    name = F.lower(F.substring("o_orderpriority", 1, 1))
    record = lambda value: F.to_json(F.struct(F.col("c_custkey").cast("string").alias("map_id"), F.create_map(name, value).alias("tags")))
    plain = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    line = F.when(plain, record(F.col("o_orderkey") % 5)).otherwise(record(rich))
    g = o.groupBy(F.col("c_mktsegment").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]).alias("l"))
    half = F.floor(F.size("l") / 2).cast("int")
    array = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    text = F.when(F.col("file").isin("BUILDING", "MACHINERY"), F.array_join("l", "\n")).when((F.col("file") == "FURNITURE") & (half > 0), F.concat(array(F.slice("l", F.lit(1), half)), F.lit("\n"), F.array_join(F.slice("l", half + 1, F.size("l")), "\n"))).otherwise(array(F.col("l")))
    return g.select("file", text.alias("text"))


TAG_FILE_SQL = """ro AS (SELECT c_mktsegment AS file, c_custkey::VARCHAR AS map_id, o_orderkey, lower(substr(o_orderpriority, 1, 1)) AS tag, o_orderkey % 5 AS n, c_mktsegment IN ('BUILDING', 'MACHINERY') AS plain, o_orderstatus AS s
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("tag_files_of_orders", f"""WITH {TAG_FILE_SQL}, p AS (SELECT * FROM ro WHERE n > 0 AND (plain OR s <> 'P'))
SELECT map_id, tag, max(n)::BIGINT AS count, coalesce(arg_max(s, o_orderkey) FILTER (NOT plain), '') AS category FROM p GROUP BY map_id, tag""")
def tag_files_of_orders(spark, sf):
    return T.positive_tags(T.records(_tag_files(spark, sf)))


@query("last_tags_of_orders", f"""WITH {TAG_FILE_SQL} SELECT map_id, arg_max(tag, o_orderkey) AS tags FROM ro WHERE n > 0 AND (plain OR s <> 'P') GROUP BY map_id""")
def last_tags_of_orders(spark, sf):
    return T.last_tag_sets(T.records(_tag_files(spark, sf))).select("map_id", F.array_join("tags", ",").alias("tags"))


@query("order_meta", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 10)::DOUBLE END AS star, (o_orderstatus = 'F')::INT::DOUBLE AS ranked,
 CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey::VARCHAR WHEN o_orderkey % 4 = 1 THEN o_orderpriority ELSE o_orderpriority || ' [v' || o_orderkey % 4 || ']' END AS hover FROM orders""")
def order_meta(spark, sf):
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(
        F.when(k % 3 == 0, F.col("o_totalprice").cast("string")).when(k % 3 == 2, "unknown").alias("star"), F.when(k % 3 == 1, k % 10).alias("star_rating"),
        F.when(F.col("o_orderstatus") == "F", " Ranked ").otherwise("graveyard").alias("status"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("title"), F.when(k % 4 > 1, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("version")))
    m = T.viewer_meta(table(spark, sf, "orders").select(k.alias("map_id"), doc.alias("doc")))
    return m.select(F.col("map_id").alias("o_orderkey"), "star", F.coalesce(S.ranked_flag(F.col("status")), F.lit(0.0)).alias("ranked"), S.hover_text(F.col("artist"), F.col("title"), F.col("version"), F.col("map_id")).alias("hover"))


@query("order_ids", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'x' || o_orderkey WHEN 3 THEN '0' || o_orderkey ELSE o_orderkey::VARCHAR END AS id FROM orders")
def order_ids(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(".0"))).when(k % 5 == 1, F.concat(F.lit(' "'), k.cast("string"), F.lit('" '))).when(k % 5 == 2, F.concat(F.lit("﻿"), k.cast("string")))
    raw = raw.when(k % 5 == 3, F.concat(F.lit("0"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", S.normal_id(raw).alias("id"))


@query("customer_id_lists", "SELECT o_custkey, o_orderkey AS id FROM orders")
def customer_id_lists(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, " x").otherwise(""))).alias("l"))
    return o.select("o_custkey", F.explode(L.id_list(F.array_join("l", ", "))).alias("id"))


@query("build_log", """WITH l AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'TIMEOUT' ELSE 'NON_STD_MODE' END AS reason FROM orders)
SELECT reason, count(*) AS n, (count(*) FILTER (reason = 'OK'))::BIGINT AS ok FROM l GROUP BY reason""")
def build_log(spark, sf):
    """Appended in two calls, by text lines and JSON lines, and read back from both."""
    reason = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "TIMEOUT").otherwise("NON_STD_MODE")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("map_id"), reason.alias("reason"))
    path = scratch(spark, "log")
    for part in (0, 1):
        sinks.append_log(o.filter(F.col("map_id") % 2 == part), path)
    ok = T.ok_ids(spark.read.text(f"{path}/log").withColumnRenamed("value", "line"))
    j = spark.read.schema("map_id long, reason string").json(f"{path}/jsonl").join(ok.withColumn("ok", F.lit(1)), F.col("map_id") == F.col("id"), "left")
    return j.groupBy("reason").agg(F.count("*").alias("n"), F.count("ok").alias("ok"))


@query("meta_documents", "SELECT c_custkey AS map_id, c_acctbal AS bpm, c_nationkey::DOUBLE AS ar, NULL::DOUBLE AS od FROM customer")
def meta_documents(spark, sf):
    """Metadata written as JSON in buckets and read back as documents with numeric keys."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("map_id"), F.col("c_acctbal").cast("string").alias("bpm"), F.col("c_nationkey").alias("ar"), F.col("c_name").alias("od"))
    path = scratch(spark, "meta")
    sinks.write_meta_json(c, path, buckets=8)
    docs = spark.read.text(path).select("value")
    n = docs.select(F.get_json_object("value", "$.map_id").cast("bigint").alias("map_id"), *T.numeric_meta(F.col("value")))
    return n.select("map_id", "bpm", "ar", "od")


@query("latest_order_id", "SELECT max(o_orderkey) AS latest FROM orders")
def latest_order_id(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return files.latest_id(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 == 8, F.concat(F.lit("x"), k)).otherwise(k).alias("id")).union(table(spark, sf, "orders").agg(F.max("o_orderkey").cast("string"))))


@query("window_masks", f"""{LABELS_SQL}, ng AS (SELECT map_id, list_distinct(list('error' || (k % 5)::VARCHAR)) AS negative FROM notes WHERE event_type = 'click' AND k % 5 < 2 GROUP BY map_id)
SELECT lab.map_id, lab.k, array_to_string(list_transform(range(5), lambda i: list_contains(labels, 'error' || i)::INT), '') AS y, array_to_string(list_transform(range(5), lambda i: coalesce(list_contains(negative, 'error' || i), false)::INT), '') AS n
FROM lab LEFT JOIN ng USING (map_id)""")
def window_masks(spark, sf):
    n = notes(spark, sf)
    tags = [f"error{i}" for i in range(5)]
    doc = F.to_json(F.create_map(F.concat(F.lit("error"), (F.col("k") % 5).cast("string")), F.struct((F.col("k") % 5 < 2).alias("is_negative"))))
    neg = n.filter("event_type = 'click'").select("map_id", T.negative_tags(doc, F.array(*[F.lit(t) for t in tags])).alias("negative"))
    m = B.negative_mask(_labelled(spark, sf), neg, tags)
    return m.select("map_id", "k", F.array_join(F.transform("y", lambda v: v.cast("string")), "").alias("y"), F.array_join(F.transform("n", lambda v: v.cast("string")), "").alias("n"))


@query("map_tag_sets", f"""WITH {NOTES_SQL}, b AS (SELECT map_id, event_type || (k % 5)::VARCHAR AS tag FROM notes WHERE event_type = 'error' UNION SELECT map_id, 'weak' || (k % 2)::VARCHAR FROM notes WHERE event_type = 'purchase' AND k % 4 > 0)
SELECT map_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM b GROUP BY map_id""")
def map_tag_sets(spark, sf):
    n = notes(spark, sf)
    spans = n.filter("event_type = 'error'").select("map_id", F.concat(F.lit(" "), "event_type", (F.col("k") % 5).cast("string")).alias("label"))
    doc = F.to_json(F.create_map(F.concat(F.lit("weak"), (F.col("k") % 2).cast("string")), F.col("k") % 4))
    weak = n.filter("event_type = 'purchase'").select("map_id", F.explode(T.truthy_tags(doc)).alias("tag"))
    return T.map_tags(spans, weak).select("map_id", F.array_join("tags", ",").alias("tags"))


@query("window_meta", f"""{LABELS_SQL}, cu AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 3 > 0), x AS (SELECT map_id, beat_ms, count(*) AS n FROM notes GROUP BY ALL)
SELECT lab.map_id, lab.k, c_acctbal AS meta_acctbal, c_nationkey AS meta_nation, NULL::DOUBLE AS absent FROM lab LEFT JOIN cu ON lab.map_id = c_custkey""")
def window_meta(spark, sf):
    n = notes(spark, sf)
    meta = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("map_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"))
    w = B.beat_windows(B.map_bounds(n))
    return B.full_features(w, meta, w.select("map_id", "k"), ["meta_acctbal", "meta_nation", "absent"]).select("map_id", "k", "meta_acctbal", "meta_nation", "absent")


@query("derived_slider_columns", """WITH n AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS len, l_discount AS vel, l_quantity - 1 AS bpm, l_tax * 4500 AS dir FROM lineitem)
SELECT l_orderkey, l_linenumber, floor((CASE WHEN vel > 1e-6 THEN len / vel END)::FLOAT::DOUBLE * 1e1 + 5e-1) / 1e1 AS dur, floor((CASE WHEN bpm > 1e-1 THEN vel * (60000e0 / bpm) END)::FLOAT::DOUBLE * 1e2 + 5e-1) / 1e2 AS beats,
 floor(cos(radians(dir))::FLOAT::DOUBLE * 1e5 + 5e-1) / 1e5 AS cx FROM n""")
def derived_slider_columns(spark, sf):
    from ..operators.notes import derived_slider_columns as derived

    n = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("slider_len_px"), F.col("l_discount").alias("slider_vel"), (F.col("l_quantity") - 1).alias("local_bpm"), (F.col("l_tax") * 4500).alias("slider_dir_deg"))
    d = derived(n)
    out = {"dur": ("slider_dur_ms", 1), "beats": ("slider_vel_beats", 2), "cx": ("slider_dir_circ_x", 5)}
    return d.select("l_orderkey", "l_linenumber", *[S.rounded(F.col(c).cast("double"), k).alias(n) for n, (c, k) in out.items()])
