"""Tag files in their three layouts (JSON lines, one array, array followed by lines), metadata with fallback keys, logs, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETAIL = "count long, is_negative boolean, category string, is_predicted boolean"


def records(texts: DataFrame) -> DataFrame:
    """(file, pos, map_id, tag, detail) of whole files (file, text), whatever their layout.

    Line ends between records become commas and outer brackets go, so that every layout reads as one array.
    """
    body = F.regexp_replace(F.trim("text"), "^﻿", "")
    joined = F.regexp_replace(body, r"\]\s*\n\s*\{", ",{")
    joined = F.regexp_replace(joined, r"\}\s*\n\s*\{", "},{")
    joined = F.regexp_replace(F.regexp_replace(F.trim(joined), r"^\[", ""), r"\]$", "")
    arr = F.from_json(F.concat(F.lit("["), joined, F.lit("]")), "array<struct<map_id:string,tags:map<string,string>>>")
    r = texts.select("file", F.posexplode(arr).alias("pos", "r")).select("file", "pos", "r.map_id", F.explode("r.tags").alias("tag", "value"))
    detail = F.from_json("value", DETAIL)
    return r.withColumn("d", detail).select(
        "file", "pos", "map_id", "tag", F.coalesce(F.col("value").try_cast("bigint"), F.col("d.count")).alias("count"),
        F.coalesce("d.is_negative", F.lit(False)).alias("negative"), F.coalesce("d.is_predicted", F.lit(False)).alias("predicted"), F.coalesce("d.category", F.lit("")).alias("category"))


def positive_tags(rec: DataFrame) -> DataFrame:
    """(map_id, tag, count, category): neither negative nor predicted; the largest count, the last category that isn't empty."""
    r = rec.filter("not negative and not predicted and count > 0")
    c = F.when(F.col("category") != "", F.col("category"))
    return r.groupBy("map_id", "tag").agg(F.max("count").alias("count"), F.coalesce(F.max_by(c, F.when(c.isNotNull(), F.struct("file", "pos"))), F.lit("")).alias("category"))


def last_tag_sets(rec: DataFrame) -> DataFrame:
    """(map_id, tags): the tags of each map's last record that has any."""
    r = rec.filter("not negative and count > 0").groupBy("map_id", "file", "pos").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return r.groupBy("map_id").agg(F.max_by("tags", F.struct("file", "pos")).alias("tags"))


def truthy_tags(tags_json: Column) -> Column:
    """Sorted names whose value isn't false, 0, null or empty, of a JSON object."""
    m = F.from_json(tags_json, "map<string, string>")
    return F.array_sort(F.map_keys(F.map_filter(m, lambda _, v: v.isNotNull() & ~F.lower(v).isin("false", "0", "0.0", "", "null", "[]", "{}"))))


def negative_tags(tags_json: Column, allowed: Column) -> Column:
    """Sorted names of a JSON object whose value says is_negative, among the allowed ones (an array column)."""
    m = F.from_json(tags_json, "map<string, string>")
    said = F.map_keys(F.map_filter(m, lambda _, v: F.coalesce(F.get_json_object(v, "$.is_negative").isin("true", "1"), F.lit(False))))
    return F.array_sort(F.array_intersect(said, allowed))


#: The numeric keys of a map's metadata that become columns.
NUMERIC_META = ("ar", "cs", "od", "hp", "bpm", "length_total", "length_drain", "count_circles", "count_sliders", "count_spinners", "note_count", "map_end_time_ms", "status_ranked")


def numeric_meta(doc: Column) -> list[Column]:
    """The numeric keys of a metadata document, null where one is missing or no number."""
    return [F.get_json_object(doc, f"$.{k}").try_cast("double").alias(k) for k in NUMERIC_META]


#: Output fields of the viewer's metadata and the keys that may hold them, in order.
META_KEYS = {
    "star": ("star", "star_rating", "difficulty_rating"), "hp": ("hp", "HPDrainRate", "drain"), "od": ("od", "OverallDifficulty", "accuracy"), "cs": ("cs", "CircleSize"),
    "ar": ("ar", "ApproachRate"), "bpm": ("bpm",), "length": ("length_total", "total_length", "length"),
}


def viewer_meta(docs: DataFrame, doc: str = "doc", key: str = "map_id") -> DataFrame:
    """(map_id, status, artist, title, version, creator and the metrics) of JSON documents, by the first key that says something."""
    d = F.col(doc)
    texts = {"status": ("status", "status_ranked", "ranked_status"), "artist": ("artist",), "title": ("title",), "version": ("version", "diff"), "creator": ("creator", "mapper")}
    return docs.select(F.col(key).alias("map_id"), *[first_text(d, *keys).alias(n) for n, keys in texts.items()], *[first_number(d, *keys).alias(n) for n, keys in META_KEYS.items()])


def map_tags(spans: DataFrame, weak: DataFrame) -> DataFrame:
    """(map_id, tags): the sorted distinct labels of a map's spans and its weak tags. spans: (map_id, label); weak: (map_id, tag)."""
    both = spans.select("map_id", F.trim("label").alias("tag")).union(weak.select("map_id", "tag")).filter("tag <> ''")
    return both.groupBy("map_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def first_number(doc: Column, *keys: str) -> Column:
    """The first of several keys of a JSON object that holds a number."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{k}").try_cast("double") for k in keys])


def first_text(doc: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(doc, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))


def last_logged_id(log: DataFrame) -> DataFrame:
    """First token of the last non-blank line of a build log (line_no, line), as a number."""
    r = log.filter(F.trim("line") != "")
    return r.agg(F.max_by(F.split(F.trim("line"), r"\s+")[0].try_cast("bigint"), F.col("line_no")).alias("last_id"))


def ok_ids(log: DataFrame) -> DataFrame:
    p = F.split(F.trim("line"), r"\s+")
    return log.filter(F.get(p, F.lit(1)) == "OK").select(p[0].try_cast("bigint").alias("id")).filter("id is not null").distinct()


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """start_ms, end_ms, label of CSV files; empty labels and empty spans go, bad rows are skipped."""
    s = spark.read.schema("start_ms long, end_ms long, label string").csv(path, header=True, mode="PERMISSIVE")
    return s.filter("start_ms < end_ms and trim(label) <> ''")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, vector) of .npy matrices, read by the executors."""

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype("float32")
                yield pd.DataFrame({"file": p, "row": range(len(x)), "vector": [r.tolist() for r in x]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, vector array<float>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Split lists: trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def ontology(spark: SparkSession, text: str) -> DataFrame:
    """Distinct tag names of a YAML ontology text, in case-insensitive order."""
    import yaml

    names = {str(t["name"]) for t in (yaml.safe_load(text) or {}).get("tags", []) if t.get("name")}
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string").orderBy(F.lower("name"), "name")
