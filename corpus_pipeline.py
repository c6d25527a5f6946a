"""A corpus pipeline of the training-data operators: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last keep the columns of documents. Columns are looked up by name; extra ones are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondo.llm import decontam, langid, mixing, neardup, token_output
from rondo.llm.common import fresh, shared_dir, table
from rondo.llm.queries import public_tokenizer

#: Words of a shingle in near_dedup.
WORDS = 4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is `und` (null or empty text, no letters) go; a missing language is filled in.

    Repeated rows and ties are judged alike; rows without doc_id or language are judged, but don't train; where no row trains,
    every text is `und` and goes; an empty table gives no rows.
    """
    (said,) = fresh(docs, "said")
    found = langid.language_of(langid.train(docs))
    known = docs.withColumn(said, found(F.col("text").cast("string"))).filter(F.col(said) != "und")
    return known.withColumn("lang", F.coalesce("lang", said)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id. Similarity is op2's: four-word shingles, 0.8.

    Rows equal in doc_id and text become one; rows that share a doc_id but not the text are documents of their own. Null,
    empty and blank texts and rows without doc_id stay; an empty table gives no rows.
    """
    return neardup.deduplicate(docs, words=WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged alike; without benchmark all stay; an empty table
    gives no rows.
    """
    return decontam.uncontaminated(docs, decontam.build(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times.

    A null source is a source of its own; repeated rows are taken alike; texts without words go with their hash; with no
    words at all nothing is taken; an empty table gives no rows.
    """
    copies, copy = fresh(docs, "copies", "copy")
    taken = mixing.with_copies(docs, mixing.source_cuts(docs), copies=copies).filter(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rANS segments, read back and digested: (doc_id, start, n_tokens, ids_crc32).

    Null and empty texts have the end id alone; null doc_ids come first, and rows that share one are in order of their text's
    hash; an empty table gives no rows.
    """
    segments, freq = token_output.write_tokens(docs, public_tokenizer("byte_bpe_50k.json"))
    return token_output.read_tokens(segments, freq, digest=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: The tokenizer and the trained models can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/rondo/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
