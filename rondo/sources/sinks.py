"""Sinks: partitioned tables, resumable appends, nested JSON and the viewer's binary points."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def write_bucketed(rows: DataFrame, path: str, key: str = "map_id", buckets: int = 64, mode: str = "overwrite") -> None:
    """One table partitioned by a hash of the key, not a file per key."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table doesn't have yet; running it twice adds nothing."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def tags_json(summary: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, json): the first k tag rows of each cluster as one JSON array."""
    s = summary.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("enrichment")).alias("o"), "tag", "tag_count", "enrichment"))).alias("t"))
    rec = F.transform(F.slice("t", 1, k), lambda x: F.struct(x["tag"].alias("tag"), x["tag_count"].alias("tag_count"), x["enrichment"].alias("enrichment")))
    return s.select("cluster", F.to_json(rec).alias("json"))


def write_tag_summary(summary: DataFrame, path: str, k: int = 10) -> None:
    """The tag table of all clusters as CSV, and as JSON lines {"cluster", "tags"}: the first k tags of each."""
    summary.write.mode("overwrite").csv(f"{path}/cluster_tag_summary.csv", header=True)
    tags_json(summary, k).select(F.concat(F.lit('{"cluster":'), F.col("cluster").cast("string"), F.lit(',"tags":'), "json", F.lit("}")).alias("value")).write.mode("overwrite").text(f"{path}/cluster_tag_summary.jsonl")


def write_meta_json(meta: DataFrame, path: str, key: str = "map_id", buckets: int = 64, mode: str = "overwrite") -> None:
    """Metadata as JSON lines in buckets of a hash of the key, instead of a file per map."""
    meta.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode(mode).partitionBy("bucket").json(path)


def append_log(reasons: DataFrame, path: str) -> None:
    """Append (map_id, reason, and more columns) to a build log: "id REASON" lines, and all columns as JSON lines beside them.

    Each call adds files of its own, so builders needn't lock each other out.
    """
    reasons.select(F.concat_ws(" ", F.col("map_id").cast("string"), "reason").alias("value")).write.mode("append").text(f"{path}/log")
    reasons.write.mode("append").json(f"{path}/jsonl")


class PointsSource(DataSource):
    """format("points_f32"): numeric columns as rows of little-endian float32, one file per task."""

    @classmethod
    def name(cls) -> str:
        return "points_f32"

    def writer(self, schema, overwrite):
        return PointsWriter(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    name: str
    partition: int


class PointsWriter(DataSourceArrowWriter):
    """Each attempt of a task writes a file of its own; those of the attempts that count are renamed at the commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        files, root = self._folder()
        files.create_dir(root, recursive=True)
        t = TaskContext.get()
        name = f"_{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{root}/{name}") as f:
            for b in batches:
                f.write(np.stack([c.to_numpy(zero_copy_only=False).astype("<f4") for c in b.columns], axis=1).tobytes())
        return Written(name, t.partitionId())

    def commit(self, messages):
        from pyarrow import fs

        files, root = self._folder()
        files.create_dir(root, recursive=True)
        there = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("points-")]
        for x in there if self.overwrite else ():
            files.delete_file(x)
        base = 0 if self.overwrite else len(there)
        for n, m in enumerate(sorted((m for m in messages if m is not None), key=lambda m: m.partition)):
            files.move(f"{root}/{m.name}", f"{root}/points-{base + n:06d}.f32")

    def abort(self, messages):
        files, root = self._folder()
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


def pack_points(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same bytes as a column: stride len(columns), big stores need no local file."""

    @F.pandas_udf("binary")
    def pack(frame: pd.DataFrame) -> pd.Series:
        x = frame.to_numpy("float32").astype("<f4")
        return pd.Series([r.tobytes() for r in x])

    return rows.withColumn("packed", pack(F.struct(*[F.col(c).cast("float") for c in columns])))
