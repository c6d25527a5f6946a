"""Helpers that every training-data operator shares."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or (tests only) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = f"/tmp/checkpoints/rondo-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rondo/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rondo_path = path  # for release()
    return out


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_rondo_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of these that df doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: What modules keep in a worker from one task to the next: by module, how much is kept (0: nothing) and how to forget it.
_kept: dict[str, tuple] = {}
#: Module whose kept things a module's batch functions use, where it isn't their own.
_USES = {"token_output": "bpe_words", "neardup": "wordhash", "decontam": "wordhash"}


def forgettable(module: str, kept, forget) -> None:
    _kept[module.rpartition(".")[2]] = kept, forget


def forget_others(module: str) -> None:
    """Forget what other operators kept in this worker, which Spark hands from stage to stage."""
    own = module.rpartition(".")[2]
    others = [forget for name, (kept, forget) in _kept.items() if name != _USES.get(own, own) and kept()]
    for forget in others:
        forget()
    if others:
        give_back()


def lean(run):
    """A batch function whose worker, which Spark keeps for later tasks, forgets what other operators kept and gives freed memory back."""

    @wraps(run)
    def wrapped(batches):
        forget_others(run.__module__ or "")
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Bytes of an Arrow batch between Spark and Python; the buffers that hold it are a few times as large, in each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, where it doesn't bound them as low: texts vary in length, rows don't tell."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not str(now).isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sliced(batches, column: int, limit: int = BATCH_BYTES):
    """Arrow batches in slices of about limit bytes of a text or binary column, one row at least: what Python holds at once."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, b.num_rows
        while at < n:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text):
    """Number of WORD runs of a text column (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks(lengths, limit: int):
    """Yield (start, stop) row ranges whose lengths sum to about limit; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
