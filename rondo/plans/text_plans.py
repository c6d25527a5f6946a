"""Queries of text parsing, tag files, metadata, mesh, sequences and sliding time windows."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rounded as R
from ..operators import mesh as M
from ..operators import sequences as Q
from ..sources import level_text as L
from ..sources import tag_files as T
from ..streaming.events import sliding_counts
from .adapters import NOTES_SQL, notes, r
from .registry import query, table

LEVEL = """osu file format v14

[General]
Mode: 0
Title: One: Two
Title: Three

[Difficulty]
HPDrainRate:5
CircleSize:4
OverallDifficulty:8
ApproachRate:x
SliderMultiplier:1.4

[TimingPoints]
1000,500,4,1,0,100,1,0
2000,-50,4,1,0,100,0,0
bad

[HitObjects]
100,100,1000,1,0
256,192,3000,2,0,B|300:192|356:192,1,100
200,200,1500,12,0
100,200,9999999999,1,0
"""
OTHER = "osu file format v14\n[General]\nMode: 3\n[HitObjects]\n1,2,3,1\n"


def _levels(spark):
    return spark.createDataFrame([("a", LEVEL), ("b", OTHER), ("c", "osu file format v14\n")], "map_id string, text string")


@query("parse_sections", """WITH t(map_id, section, n) AS (VALUES ('a', 'General', 3), ('a', 'Difficulty', 5), ('a', 'TimingPoints', 3), ('a', 'HitObjects', 4), ('b', 'General', 1), ('b', 'HitObjects', 1)) SELECT map_id, section, n::BIGINT AS n FROM t""")
def parse_sections(spark, sf):
    return L.sections(_levels(spark)).groupBy("map_id", "section").agg(F.count("*").alias("n"))


@query("parse_key_values", "WITH t(map_id, key, value) AS (VALUES ('a', 'Mode', '0'), ('a', 'Title', 'Three'), ('b', 'Mode', '3')) SELECT * FROM t")
def parse_key_values(spark, sf):
    return L.key_values(L.sections(_levels(spark)), "General")


@query("parse_difficulty", "SELECT 'a' AS map_id, 5e0 AS HPDrainRate, 4e0 AS CircleSize, 8e0 AS OverallDifficulty, NULL::DOUBLE AS ApproachRate, 1.4e0 AS SliderMultiplier, NULL::DOUBLE AS SliderTickRate")
def parse_difficulty(spark, sf):
    return L.difficulty(L.sections(_levels(spark)))


@query("parse_timing", "WITH t(map_id, t_ms, kind, value) AS (VALUES ('a', 1000, 'bpm', 120e0), ('a', 2000, 'sv', 2e0)) SELECT map_id, t_ms::BIGINT AS t_ms, kind, value FROM t")
def parse_timing(spark, sf):
    return L.timing(L.sections(_levels(spark))).select("map_id", "t_ms", "kind", "value")


@query("parse_level_text", """WITH t(map_id, t_ms, x, obj_type, curve, slider_len, slider_anchors, la_x) AS (VALUES ('a', 1000, 100e0, 'circle', NULL, NULL, NULL, NULL), ('a', 3000, 256e0, 'slider', 'B', 100e0, 2, 356e0),
 ('a', 1500, 200e0, 'spinner', NULL, NULL, NULL, NULL), ('b', 3, 1e0, 'circle', NULL, NULL, NULL, NULL)) SELECT map_id, t_ms::BIGINT AS t_ms, x, obj_type, curve, slider_len, slider_anchors, la_x FROM t""")
def parse_level_text(spark, sf):
    return L.hit_objects(L.sections(_levels(spark))).select("map_id", "t_ms", "x", "obj_type", "curve", "slider_len", "slider_anchors", "la_x")


@query("skip_reasons", "WITH t(map_id, reason) AS (VALUES ('a', 'OK'), ('b', 'NON_STD_MODE'), ('c', 'NO_HITOBJECTS')) SELECT * FROM t")
def skip_reasons(spark, sf):
    return L.skip_reason(_levels(spark))


TAG_FILES = [
    ("1", '{"map_id":"1","tags":{"aim":4}}\n{"map_id":"2","tags":{"flow":1}}\n'),
    ("2", '[{"map_id":"1","tags":{"aim":{"count":4,"is_negative":false,"category":"pattern_type"},"bad":{"count":2,"is_negative":true}}}]'),
    ("3", '[{"map_id":"1","tags":{"aim":{"count":4,"is_negative":false,"category":"pattern_type"}}}]\n{"map_id":"1","tags":{"aim":2}}\n{"map_id":"3","tags":{"jump":5}}'),
]


@query("tag_file_layouts", """WITH t(file, map_id, tag, count, category) AS (VALUES ('1', '1', 'aim', 4, ''), ('1', '2', 'flow', 1, ''), ('2', '1', 'aim', 4, 'pattern_type'), ('3', '1', 'aim', 4, 'pattern_type'), ('3', '3', 'jump', 5, '')) SELECT file, map_id, tag, count::BIGINT AS count, category FROM t""")
def tag_file_layouts(spark, sf):
    f = spark.createDataFrame(TAG_FILES, "file string, text string")
    rec = T.records(f).withColumn("map_id", F.concat_ws("/", "file", "map_id"))
    t = T.positive_tags(rec)
    return t.select(F.split("map_id", "/")[0].alias("file"), F.split("map_id", "/")[1].alias("map_id"), "tag", "count", "category")


@query("tag_sets_last", "WITH t(map_id, tags) AS (VALUES ('1', 'aim'), ('2', 'flow'), ('3', 'jump')) SELECT * FROM t")
def tag_sets_last(spark, sf):
    return T.last_tag_sets(T.records(spark.createDataFrame(TAG_FILES, "file string, text string"))).select("map_id", F.array_join("tags", ",").alias("tags"))


@query("event_props_tags", "SELECT event_id, CASE WHEN json_extract(props, '$.k')::BIGINT <> 0 THEN 'k' ELSE '' END AS tags FROM events")
def event_props_tags(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(T.truthy_tags(F.col("props")), ",").alias("tags"))


META = [("1", '{"star":"5.5","status":" Ranked ","artist":"A","title":"T","version":"V"}'), ("2", '{"difficulty_rating":3,"status":"loved","title":"Only"}'), ("3", '{"star":"x"}')]


@query("meta_fallback", "WITH t(map_id, star, ranked, hover) AS (VALUES ('1', 5.5e0, 1e0, 'A - T [V]'), ('2', 3e0, 0e0, 'Only'), ('3', NULL, 0e0, '3')) SELECT * FROM t")
def meta_fallback(spark, sf):
    m = spark.createDataFrame(META, "map_id string, doc string")
    d = F.col("doc")
    return m.select("map_id", T.first_number(d, "star", "star_rating", "difficulty_rating").alias("star"), F.coalesce(S.ranked_flag(T.first_text(d, "status")), F.lit(0.0)).alias("ranked"),
                    S.hover_text(T.first_text(d, "artist"), T.first_text(d, "title"), T.first_text(d, "version"), F.col("map_id")).alias("hover"))


@query("id_normalisation", """WITH t(raw, id) AS (VALUES ('12.0', '12'), ('007', '007'), ('"5"', '5'), (' 8 ', '8'), ('x1', 'x1')) SELECT * FROM t""")
def id_normalisation(spark, sf):
    d = spark.createDataFrame([("12.0",), ("007",), ('"5"',), (" 8 ",), ("x1",)], "raw string")
    return d.select("raw", S.normal_id(F.col("raw")).alias("id"))


@query("id_list_parse", "WITH t(id) AS (VALUES (3), (7), (12)) SELECT id::BIGINT AS id FROM t")
def id_list_parse(spark, sf):
    return spark.createDataFrame([("3, x 7,12",)], "s string").select(F.explode(L.id_list(F.col("s"))).alias("id"))


LOG = [(0, "5 OK"), (1, "6 RAW_404"), (2, ""), (3, "9 OK "), (4, "10 TIMEOUT")]


@query("log_scans", "WITH t(what, id) AS (VALUES ('last', 10), ('ok', 5), ('ok', 9)) SELECT what, id::BIGINT AS id FROM t")
def log_scans(spark, sf):
    log = spark.createDataFrame(LOG, "line_no int, line string")
    return T.last_logged_id(log).select(F.lit("last").alias("what"), F.col("last_id").alias("id")).union(T.ok_ids(log).select(F.lit("ok"), "id"))


@query("scalar_features", f"""SELECT p_partkey, {r("least(greatest(CASE WHEN p_size / 5e0 < 5 THEN 1200 + 120 * (5 - p_size / 5e0) ELSE 1200 - 150 * (p_size / 5e0 - 5) END, 300e0), 1800e0)", 4)} AS preempt, {r('CASE WHEN p_retailprice > 0 THEN (p_retailprice - p_size) / p_retailprice ELSE 0 END')} AS drop FROM part""")
def scalar_features(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", R(S.preempt_ms(F.col("p_size") / 5.0), 4).alias("preempt"), R(S.percent_drop(F.col("p_retailprice"), F.col("p_size"))).alias("drop"))


@query("icosphere")
def icosphere(spark, sf):
    v, f, e = M.mesh_tables(spark, 2)
    return v.agg(F.count("*").alias("vertices")).crossJoin(F.broadcast(f.agg(F.count("*").alias("faces")))).crossJoin(F.broadcast(e.agg(F.count("*").alias("edges"))))  # single rows


def _mesh(spark, sf):
    e = table(spark, sf, "embeddings")
    n = F.sqrt(sum(F.element_at("embedding", k) * F.element_at("embedding", k) for k in (1, 2, 3)).cast("double"))
    p = e.select(F.col("vec_id").alias("id"), *[(F.element_at("embedding", k).cast("double") / n).alias(a) for k, a in ((1, "x"), (2, "y"), (3, "z"))], F.col("label").cast("double").alias("value"), F.lit(1.0).alias("weight"))
    v, f, ed = M.mesh_tables(spark, 2)
    return v, f, ed, M.vertex_field(p, v, 12)


@query("mesh_field")
def mesh_field(spark, sf):
    return _mesh(spark, sf)[3].select("v", R(F.col("value")).alias("value"))


@query("mesh_smooth")
def mesh_smooth(spark, sf):
    _, _, e, field = _mesh(spark, sf)
    return M.smooth(field, e, 2)


@query("mesh_surface")
def mesh_surface(spark, sf):
    _, f, _, field = _mesh(spark, sf)
    return M.face_values(f, field)


@query("mesh_contours")
def mesh_contours(spark, sf):
    v, f, _, field = _mesh(spark, sf)
    return M.iso_lines(f, v, field, [3.0, 5.0]).select("level", "face", F.size("path").alias("points"))


@query("encode_sequences")
def encode_sequences(spark, sf):
    n = notes(spark, sf).withColumn("x", F.col("x") / 512).withColumn("y", F.col("y") / 384)
    return Q.embed_maps(n, "map_id", "t_ms", ["x", "y"], Q.Encoder.new(2))


@query("sequence_padding", f"WITH {NOTES_SQL}, g AS (SELECT map_id, list(k::DOUBLE ORDER BY t_ms, line_no) AS s FROM notes GROUP BY map_id) SELECT map_id, array_to_string(list_transform(range(1, 101), lambda i: coalesce(s[i], 0)::BIGINT), ',') AS padded, least(len(s), 100)::INT AS n FROM g")
def sequence_padding(spark, sf):
    g = notes(spark, sf).groupBy("map_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_ms", "line_no", F.col("k").cast("double").alias("k")))), lambda s: s["k"]).alias("s"))
    p, m = Q.pad(F.col("s"), 100)
    return g.select("map_id", F.array_join(F.transform(p, lambda v: v.cast("bigint").cast("string")), ",").alias("padded"), F.aggregate(m, F.lit(0), lambda a, b: a + b).alias("n"))


@query("sliding_time_window", f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events), w AS (SELECT user_id, value, (us // 10800000000 - o) * 10800000000 AS s FROM e, (SELECT unnest([0, 1]) AS o))
SELECT user_id, s // 1000000 AS start_s, count(*) AS n, {r('avg(value)', 4)} AS mean_value FROM w GROUP BY user_id, s""")
def sliding_time_window(spark, sf):
    d = sliding_counts(table(spark, sf, "events"))
    return d.select("user_id", F.unix_seconds("start").alias("start_s"), "n", R(F.col("mean_value"), 4).alias("mean_value"))
