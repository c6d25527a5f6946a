"""The pipeline, stage by stage, against brute force; and on an awkward table."""

import re
import sys
import zlib
from collections import Counter as Bag
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as P  # noqa: E402
from test_ops import SCHEMA, brute_components, expected_tokens  # noqa: E402

SF = "/root/testdata/sf0.001"


def store(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(9001, "123 456", "en", "src0", 7), (9002, None, None, "src1", 0), (9003, "Only a short one here", None, "src2", 21)], docs.schema))
    bench = [re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "near_dedup", "decontaminate", "mix", "tokens"]
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        out.append(store(stage(spark, out[-1], SF), tmp_path / str(k)))
    for df in out[1:-1]:
        assert df.columns == docs.columns
    before, known, alone, clean, mixed, tokens = [df.collect() for df in out[:-1]] + [out[-1]]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in known} == {9001, 9002} and all(r["lang"] for r in known)
    want = brute_components([(r["doc_id"], r["text"]) for r in known])
    assert {r["doc_id"] for r in alone} == {c for _, c in want.values()}
    gone = {r["doc_id"]: r["text"] for r in alone if r["doc_id"] not in {x["doc_id"] for x in clean}}
    held = {r["doc_id"] for r in alone if any(" ".join(b) in " ".join(re.findall(r"[^\W_]+", r["text"].lower())) for b in bench)}
    assert held <= set(gone) and len(gone) <= len(held) + 2
    copies = Bag(r["doc_id"] for r in mixed)
    assert set(copies) <= {r["doc_id"] for r in clean} and max(copies.values()) <= 3
    assert sorted((tuple(r) for r in tokens.collect()), key=lambda r: r[1]) == expected_tokens(out[-2])


def test_repeated_ids_with_different_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(120)]
    one, two, three = (" ".join(f"{p}{w}" for w in words) for p in "abc")
    near = one.replace("aw60", "other")
    rows = [(1, one), (5, near), (5, two), (5, two), (7, three), (9, two), (9, "something else that nothing is like"), (7, three + " end"), (None, one)]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t)) for k, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = store(P.near_dedup(spark, docs, SF), tmp_path / "out")
    assert got.columns == docs.columns
    kept = Bag((r["doc_id"], r["text"]) for r in got.collect())
    third = [t for k, t in kept if k == 7]
    assert len(third) == 1 and third[0] in (three, three + " end")
    assert kept - Bag([(7, third[0])]) == Bag([(1, one), (5, two), (9, "something else that nothing is like"), (None, one)])


def test_awkward_documents(spark, tmp_path):
    rows = [(i, t, None, None, None, 1, 2, 3, b"") for i, t in enumerate(["Hello there my good old friend", "Hello there my good old friend", "", None, "ß"])] + [(None, "A text without any key at all", None, None, None, 1, 2, 3, b"")] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for d in (docs, docs.limit(0)):
        d = store(d, tmp_path / f"in{d.count()}")
        n = d.count()
        for k, (_, stage) in enumerate(P.STAGES):
            d = store(stage(spark, d, SF), tmp_path / f"{n}-{k}")
        assert d.count() <= 3 * n and all(r["ids_crc32"] >= 0 for r in d.collect())
        if n:
            assert {r["doc_id"] for r in d.collect()} <= {0, 4, None}
            assert zlib.crc32(b"") == 0
