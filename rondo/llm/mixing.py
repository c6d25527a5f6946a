"""Mixing sources to target weights by hash-threshold histograms (operator 9), DataFrame functions only.

Method: each source has a target of words. A document is taken floor(target / source size) times, and once more if
its hash lies under the source's threshold. Thresholds come from histograms: words are summed by source and hash
bucket, prefix sums over the buckets show where the budget is met, and only that boundary bucket is split into finer
buckets, until it holds one hash value. Nothing is sorted but bucket counts, and thresholds of smaller budgets are
lower, so mixes are nested. A hot source is only ever pre-aggregated.

Edge cases: null and empty texts have size 0 and are taken 0 words; null sources form a source of their own, last in
order; rows that share a doc_id share a hash and are taken alike, and rows without one those that share a text; an empty table gives no rows; with no words at all
every target is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words, release

#: Levels of the histogram and bits of each: the last bucket is one value of the 48-bit hash.
LEVELS, BITS = 4, 12
#: Up to so many sources the table of thresholds (under 100 bytes a row) is broadcast; beyond, AQE joins it.
BROADCAST_SOURCES = 50_000
WEIGHTS, REPEATS = (1, 2, 3), 3


def hash48(key, text=None) -> F.Column:
    """48 bits of md5, the same in any engine. Rows without a key are told apart by their text, if that is given."""
    name = key.cast("string")
    if text is not None:
        name = F.coalesce(name, F.concat(F.lit("text:"), text.cast("string")))
    return F.conv(F.substring(F.md5(F.coalesce(name, F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def _numbered(rows: DataFrame, order: Sequence, sums: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """rows with nth (from 0) and, for each column x of sums, before_x, the sum over all rows before; and the table to release.

    Few rows go through one window. Many are dealt by range; the totals of the partitions, as many as tasks, give each its offset.
    """
    few = _small(rows)
    ranged = rows.withColumn("pid", F.lit(0)) if few else materialize(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "mix-ranged")
    inside = W.partitionBy("pid").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    out = ranged.select("*", (F.row_number().over(inside) - 1).cast("long").alias("nth"), *[F.coalesce(F.sum(x).over(before), F.lit(0e0)).alias(f"before_{x}") for x in sums])
    if not few:
        parts = ranged.groupBy("pid").agg(F.count("*").alias("rows_"), *[F.sum(x).alias(f"all_{x}") for x in sums])
        prior = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
        base = parts.select("pid", F.coalesce(F.sum("rows_").over(prior), F.lit(0)).alias("rows_"), *[F.coalesce(F.sum(f"all_{x}").over(prior), F.lit(0e0)).alias(f"all_{x}") for x in sums])
        out = out.join(F.broadcast(base), "pid")  # one row a task
        out = out.withColumns({"nth": F.col("nth") + F.col("rows_"), **{f"before_{x}": F.col(f"before_{x}") + F.col(f"all_{x}") for x in sums}})
        out = out.drop("rows_", *[f"all_{x}" for x in sums])
    return out.drop("pid"), ranged


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of rows (source, size): all words shared by weight, none above repeats times its size.

    Resharing until none is above has a closed form: sources in order of cap / weight fill up one after another, and
    the first that doesn't fill sets the level.
    """
    by = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    w = F.array(*[F.lit(float(x)) for x in weights])
    named, ranged = _numbered(by, [F.col("source").asc_nulls_last()], ())
    s = named.select("source", "source_size", F.element_at(w, (F.col("nth") % len(weights) + 1).cast("int")).alias("w"))
    s = s.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    full_at = F.col("cap") / F.col("w")
    s, _ = _numbered(s.withColumn("fills", full_at), [F.col("fills").asc(), F.col("source").asc_nulls_last()], ("cap", "w"))
    total = s.agg(F.sum("source_size").cast("double").alias("words"), F.sum("w").alias("weight"))  # one row
    s = s.crossJoin(F.broadcast(total)).withColumn("level", (F.col("words") - F.col("before_cap")) / (F.col("weight") - F.col("before_w")))
    full = F.col("cap") <= F.col("level") * F.col("w")
    # The first in order: of equal fills that with the largest level.
    least = s.agg((-F.min(F.when(~full, F.struct("fills", (-F.col("level")).alias("v"))))["v"]).alias("lambda"))  # one row
    s = s.crossJoin(F.broadcast(least))
    out = materialize(s.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("lambda") * F.col("w")).alias("target")), "mix-targets")
    release(by)
    release(ranged)
    return out


def thresholds(sizes: DataFrame, budgets: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """(source, threshold): documents with hash < threshold have words nearest to the budget of their source.

    sizes: (source, size, u) with u of LEVELS * BITS bits; budgets: (source, budget), 0 <= budget <= words of the source.
    Tables that may be released once the result was read are added to held.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("rest"), F.lit(0).cast("long").alias("lo"))
    rows = sizes
    for level in range(1, LEVELS + 1):
        width = 1 << BITS * (LEVELS - level)
        if level > 1:  # only the rows of the boundary buckets are read on
            edge = state.select(F.col("source").alias("s_"), F.col("lo").alias("lo_"))
            rows = rows.join(
                F.broadcast(edge) if _small(state) else edge,
                F.col("source").eqNullSafe(F.col("s_"))
                & (F.shiftright("u", BITS * (LEVELS - level + 1)) == F.shiftright("lo_", BITS * (LEVELS - level + 1))),
                "left_semi",
            )
        hist = rows.groupBy("source", F.shiftright("u", BITS * (LEVELS - level)).alias("b")).agg(F.sum("size").alias("n"))
        # Sum n below each bucket of the source: at most 2^BITS rows a source.
        upto = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        cum = hist.withColumn("c", F.sum("n").over(upto))
        s, c = state.alias("s"), cum.alias("c")
        j = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left")
        # The boundary bucket: the first whose prefix sum goes beyond what is left of the budget.
        over = F.col("c.c") > F.col("s.rest")
        best = j.groupBy(F.col("s.source").alias("source"), "rest", "lo").agg(
            F.min(F.when(over, F.struct(F.col("c.b").alias("b"), (F.col("c.c") - F.col("c.n")).alias("under"), F.col("c.n").alias("n")))).alias("e"),
            F.max("c.c").alias("all"),
        )
        if level < LEVELS:
            nxt = best.select(
                "source",
                F.when(F.col("e").isNull(), F.lit(0e0)).otherwise(F.col("rest") - F.col("e.under")).alias("rest"),
                F.when(F.col("e").isNull(), F.lit(1 << 62)).otherwise(F.col("e.b") * width).cast("long").alias("lo"),
            )
            # A source whose budget takes everything keeps lo = 2^62 and meets no bucket further on.
            state = materialize(nxt, f"mix-level{level}")
            if held is not None:
                held.append(state)
        else:
            # One hash value is left: take it if that comes nearer to the budget.
            near = (F.col("rest") - F.col("e.under")) * 2 >= F.col("e.n")
            thr = F.when(F.col("e").isNull(), F.lit(1 << 62)).otherwise(F.when(near, F.col("e.b") + 1).otherwise(F.col("e.b")))
            return best.select("source", thr.cast("long").alias("threshold"))
    raise AssertionError


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def source_cuts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per source: (source, source_size, target, whole, threshold). Only (source, size, hash) of the rows is stored."""
    sizes = materialize(docs.select(docs[source].cast("string").alias("source"), n_words(docs[text]).alias("size"), hash48(docs[key], docs[text]).alias("u")), "mix-sizes")
    targets = source_targets(sizes, weights, repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole)
    part = F.col("target") - F.col("whole") * F.col("source_size")
    held: list[DataFrame] = []
    cut = plan.alias("p").join(thresholds(sizes, plan.select("source", part.alias("budget")), held).alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    out = materialize(cut.select("p.source", "source_size", "target", "whole", F.when(part > 0, F.col("threshold")).otherwise(F.lit(0)).cast("long").alias("threshold")), "mix-cut")
    for df in (sizes, targets, *held):
        release(df)
    return out


def with_copies(
    rows: DataFrame, cuts: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", copies: str = "copies", carry: Sequence[str] = ()
) -> DataFrame:
    """rows with one more column, how often the mix takes each, and columns of cuts. No row is shuffled while the sources are few."""
    at, whole, cut, hash_ = fresh(rows, "at", "whole", "cut", "hash")
    c = cuts.select(F.col("source").alias(at), F.col("whole").alias(whole), F.col("threshold").alias(cut), *carry)
    named = rows.withColumn(hash_, hash48(rows[key], rows[text]))
    j = named.join(F.broadcast(c) if _small(cuts) else c, named[source].cast("string").eqNullSafe(F.col(at)))
    return j.withColumn(copies, F.col(whole) + (F.col(hash_) < F.col(cut)).cast("long")).drop(at, whole, cut, hash_)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies): how many words and copies of each row the mix takes."""
    rows = docs.select(docs[key].alias("doc_id"), docs[source].cast("string").alias("source"), docs[text].alias("text"))
    mixed = with_copies(rows, source_cuts(docs, weights, repeats, text, source, key), carry=("source_size", "target"))
    size = n_words(F.col("text"))
    return mixed.select("doc_id", "source", size.alias("size"), "source_size", "target", (F.col("copies") * size).alias("taken"), "copies")
