"""Token ids in a binary format of interleaved rANS segments (operator 1).

Documents are range-partitioned by doc_id and tokenized once, in order, into raw segments of whole documents. Counts of
all tokens give one shared frequency table; segments are then coded independently of each other and written as rows
of a Parquet table (`segments`) beside the table of frequencies (`table`), in the shared folder, so that any executor
can decode any segment, or any block of one from a checkpoint. Only the vocabulary's counts and one number per
partition are ever gathered.

Edge cases: a null or empty text has only the end id; null doc_ids come first; rows that share a doc_id keep the order
of their text's hash; an empty table gives no segments; a document longer than a segment makes a longer one; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_words import encoder
from .common import chunks, lean, materialize, release, sliced, small_batches
from .rans import Table, encode_segment, open_segment

#: Tokens after which a segment ends, and characters tokenized at once.
SEGMENT, AT_ONCE = 1 << 20, 1 << 19
RAW = "pid int, seq int, first long, n_tokens long, doc_ids array<bigint>, lens array<bigint>, ids binary, seen binary, times binary"


def _raw_segments(path: str, end_id: int):
    @lean
    def run(batches):
        enc = encoder(path)
        pid, seq, first = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(enc.size, np.int64)
        keys, ids, n = [], [], 0
        end = np.array([end_id], enc.dtype)

        def flush(last: bool):
            nonlocal seq, first, keys, ids, n
            lens = [len(x) for x in ids]
            seen = np.flatnonzero(counts) if last else None
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([pid], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())),
                    pa.array([b"".join(x.astype("<u4").tobytes() if enc.dtype.itemsize == 4 else x.tobytes() for x in ids)], pa.binary()),
                    pa.array([seen.astype("<u4").tobytes() if last else None], pa.binary()),
                    pa.array([counts[seen].astype("<u8").tobytes() if last else None], pa.binary()),
                ],
                [x.split()[0] for x in RAW.split(", ")],
            )
            seq, first, keys, ids, n = seq + 1, first + n, [], [], 0
            return row

        for b in sliced(batches, 1):
            texts, doc_ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for s, e in chunks([len(t or "") for t in texts], AT_ONCE):
                for k, x in zip(doc_ids[s:e], enc.ids(texts[s:e])):
                    x = np.concatenate([x, end])
                    keys.append(k)
                    ids.append(x)
                    n += len(x)
                flat = np.concatenate(ids[-(e - s):])
                counts += np.bincount(flat, minlength=enc.size)
                if n >= SEGMENT:
                    yield flush(False)
        if keys or counts.any():
            yield flush(True)

    return run


def shared_table(raw: DataFrame, size: int) -> Table:
    """The frequency table of all tokens. At most one count per vocabulary entry reaches the driver."""

    @lean
    def run(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            for seen, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[np.frombuffer(seen, "<u4")] += np.frombuffer(times, "<u8").astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["id", "n"])

    rows = raw.select("seen", "times").filter("seen is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for i, n in rows:
        counts[i] = n
    return Table.of_counts(counts)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Tokenize and code all documents in ascending doc_id order: (segments, table), as read from their files."""
    spark = docs.sparkSession
    small_batches(spark)
    body = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = body.repartitionByRange(*order).sortWithinPartitions(*order)
    raw = materialize(ranged.mapInArrow(_raw_segments(tokenizer_path, end_id), RAW), "tokens-raw")
    size = encoder(tokenizer_path).size
    shared = shared_table(raw, size)
    table = materialize(
        spark.createDataFrame([(shared.crc, bytearray(shared.freq.astype("<u4").tobytes()))], "table_crc long, freq binary"), "tokens-table"
    )
    parts = raw.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    # One row per partition of the range shuffle: bounded by the number of tasks, whatever the data.
    base = parts.select("pid", F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    freq = shared.freq.astype("<u4").tobytes()
    width = "<u2" if size <= 1 << 16 else "<u4"

    @lean
    def code(batches):
        t = Table(np.frombuffer(freq, "<u4"))
        for b in sliced(batches, 5):
            for r in b.to_pylist():
                blob = encode_segment(np.frombuffer(r["ids"], width), r["doc_ids"], r["lens"], r["base"] + r["first"], t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["base"] + r["first"]], pa.int64()), pa.array([r["n_tokens"]], pa.int64()), pa.array([blob], pa.binary())],
                    ["start", "n_tokens", "segment"],
                )

    coded = raw.select("pid", "first", "n_tokens", "doc_ids", "lens", "ids").join(F.broadcast(base), "pid").mapInArrow(code, "start long, n_tokens long, segment binary")
    segments = materialize(coded, "tokens-segments", "none")
    release(raw)
    return segments, table


def read_tokens(segments: DataFrame, table: DataFrame, digest: bool = False) -> DataFrame:
    """Decode segments: (doc_id, start, ids), or (doc_id, start, n_tokens, ids_crc32) as digest."""
    freq = bytes(table.first()["freq"])

    @lean
    def run(batches):
        t = Table(np.frombuffer(freq, "<u4"))
        for b in sliced(batches, 0):
            for blob in b.column(0).to_pylist():
                s = open_segment(blob, t)
                flat = s.ids().astype("<u4")
                ends = np.cumsum(s.lens.astype(np.int64))
                starts = ends - s.lens.astype(np.int64)
                head = [pa.array(s.doc_ids, pa.int64()), pa.array(starts + s.start, pa.int64())]
                if digest:
                    crc = [zlib.crc32(flat[a:e]) for a, e in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([*head, pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    for a, e in chunks((ends - starts).tolist(), SEGMENT // 4):
                        ids = [flat[x:y].astype(np.int64) for x, y in zip(starts[a:e].tolist(), ends[a:e].tolist())]
                        yield pa.RecordBatch.from_arrays([*[h[a:e] for h in head], pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" if digest else "doc_id long, start long, ids array<bigint>"
    return segments.select("segment").mapInArrow(run, out)
