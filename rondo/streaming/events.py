"""Streaming forms: sliding time windows with a watermark, and the kinematic chain as keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(events: DataFrame, length: str = "6 hours", slide: str = "3 hours", late: str | None = "1 day") -> DataFrame:
    """Count and mean value per user and window. Works on a stream (with a watermark) and on a table alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and late:
        e = e.withWatermark("ts", late)
    g = e.groupBy("user_id", F.window("ts", length, slide)).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return g.select("user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean_value")


OUT = "map_id long, t_ms long, vel_x double, accel_x double, absement_x double"
STATE = "t long, x double, vel double, absement double"


def stateful_kinematics(notes: DataFrame) -> DataFrame:
    """Velocity, acceleration and running integral per key over a stream, rows of a trigger taken in time order."""

    def step(key, frames, state: GroupState):
        t = x = vel = None
        total = 0.0
        if state.exists:
            t, x, vel, total = state.get
        out = []
        rows = pd.concat(list(frames)).sort_values("t_ms")
        for now, at in zip(rows["t_ms"].tolist(), rows["x"].tolist()):
            dt = now - t if t is not None else None
            v = (at - x) / dt if dt and dt > 0 else None
            a = (v - vel) / dt if v is not None and vel is not None else None
            total += at * dt if dt and dt > 0 else 0.0
            out.append((key[0], now, v, a, total))
            t, x, vel = now, at, v
        state.update((t, x, vel, total))
        yield pd.DataFrame(out, columns=["map_id", "t_ms", "vel_x", "accel_x", "absement_x"])

    return notes.select("map_id", "t_ms", "x").groupBy("map_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def available_now(spark: SparkSession, source: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Process what has arrived since the last run, then stop: the incremental scan. The checkpoint holds the offsets."""
    q = source.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)
