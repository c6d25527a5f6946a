"""Small driver-side files on the Hadoop file system, and file names as tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it and renamed, so that a reader never sees half of it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.writing")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(aside, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=1))


def read_json(spark: SparkSession, path: str) -> Any:
    """A small JSON file's value; None where the file is missing or isn't JSON."""
    text = read_text(spark, path)
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def file_ids(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_w4b\.parquet$") -> DataFrame:
    """(id): what the pattern's first group finds in the names of the files below a path. No content is read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", pattern, 1).alias("id"))
    return names.filter("id <> ''").distinct()


def latest_id(ids: DataFrame, column: str = "id") -> DataFrame:
    """(latest): the greatest whole number among the ids; null if there is none."""
    return ids.agg(F.max(F.col(column).try_cast("bigint")).alias("latest"))


def read_by_map(spark: SparkSession, path: str, pattern: str = r"([^/]+?)_w4b\.parquet$", order: str | None = None) -> DataFrame:
    """Parquet files of single maps as one table, with map_id from each file's name; sorted by a column within a map's rows on request."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)
    rows = rows.withColumn("map_id", F.regexp_extract(F.input_file_name(), pattern, 1))
    return rows.repartition("map_id").sortWithinPartitions("map_id", order) if order else rows
