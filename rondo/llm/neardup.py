"""Near-duplicates by b-bit MinHash (operator 2).

1. Every text becomes its set of word shingles; sets become K minima, of which the low BITS bits are packed into a
   signature, and the first BANDS * ROWS of them, ROWS at a time, into band keys. Texts with equal sets are one node
   from here on.
2. Nodes that share a band key are candidates. Round one pairs each node with the smallest of all its buckets, one pair
   a node; then with the smallest of each bucket, where that bears another label by now. A bucket of any size gives
   at most as many pairs as it has nodes.
3. The share of agreeing b-bit values, corrected for chance agreement, estimates the similarity by bit counts; pairs far
   below the threshold (SIGMAS standard deviations: 1 in 3 million at the threshold) go.
4. Pairs left are confirmed on the full sets, beside each other in salted groups of at most GROUP documents.
5. Round two takes the pairs of a bucket that round one left with different labels, in blocks of BLOCK nodes against
   blocks, with the estimate as join condition and each pair only in the first band that it shares, and confirms those.
   The nodes of such buckets get a second, longer signature of WIDE minima first: large groups just below the
   threshold would otherwise leave most of their pairs to be confirmed. So each candidate pair is either confirmed or denied on
   full sets, denied by an estimate of step 3, or already connected, and no group is expanded into all of its pairs.
6. Components follow by large-star and small-star steps on tables.

Recall: a pair at exactly 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6, an estimate denies it with one of
3e-7 each, and both are less above; every link found is exact.

Edge cases: null, empty and blank texts have no shingles and stand alone; a text of fewer words than a shingle is one
shingle; a doc_id that occurs with several texts is one document that has the links of all of them (deduplicate: documents
of their own); a row without doc_id stands alone (component null) and is kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import chunks, fresh, lean, materialize, release, sliced, small_batches

BANDS, ROWS, BITS, SIGMAS = 24, 4, 2, 5
K, WIDE = 256, 2048
GROUP, BLOCK = 64, 256
#: Up to so many ids the confirmation's document filter is broadcast (8 bytes each); beyond, texts are shuffled.
BROADCAST_IDS = 500_000
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, K + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, K + WIDE, dtype=np.uint64)
PAIRS = 0x5555555555555555


def minima(sets: np.ndarray, starts: np.ndarray, first: int = 0, k: int = K) -> np.ndarray:
    """(documents, k) minima of non-empty sets that lie one after another, under hash functions first to first + k - 1."""
    out = np.empty((len(starts), k), np.uint32)
    for i in range(k):
        out[:, i] = np.minimum.reduceat((sets * _MUL[first + i] + _ADD[first + i]) >> np.uint64(32), starts)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 64 bits to a word."""
    per = 64 // BITS
    bits = (m & ((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), m.shape[1] // per, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(m: np.ndarray) -> np.ndarray:
    h = np.full((len(m), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = wordhash.mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return h


SIGS = "doc_id long, digest long, n_shingles long, set_hash binary, sig array<bigint>, bands array<bigint>"


def signatures(docs: DataFrame, words: int = 4) -> DataFrame:
    """Set size, set hash, b-bit signature and band keys of each row (the last three null for an empty set).

    docs: (doc_id, text, digest), the digest being a hash of the text that goes along.
    """

    @lean
    def run(batches):
        for b in sliced(batches, 1):
            texts, keys, digests = b.column(1).to_pylist(), b.column(0), b.column(2)
            for s, e, h, at in wordhash.many(texts):
                sets = [wordhash.shingles(h[x:y], words) for x, y in zip(at[:-1], at[1:])]
                size = np.array([len(x) for x in sets])
                full = np.flatnonzero(size)
                digest = [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets]
                sig: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if len(full):
                    m = minima(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(size[full])[:-1]]))
                    for i, a, c in zip(full.tolist(), packed(m).view(np.int64).tolist(), band_keys(m).view(np.int64).tolist()):
                        sig[i], bands[i] = a, c
                yield pa.RecordBatch.from_arrays(
                    [keys[s:e], digests[s:e], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "digest", "n_shingles", "set_hash", "sig", "bands"],
                )

    return docs.select("doc_id", "text", "digest").mapInArrow(run, SIGS)


def estimate(a: str, b: str, k: int = K) -> F.Column:
    """Collision-corrected similarity of two signature columns of k minima by bit counts."""
    differ = sum(
        F.bit_count(((t := F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))).bitwiseOR(F.shiftrightunsigned(t, 1))).bitwiseAND(F.lit(PAIRS)))
        for i in range(k * BITS // 64)
    )
    chance = 2.0**-BITS
    return ((1 - differ / k) - chance) / (1 - chance)


def floor_of(threshold: float, k: int = K) -> float:
    """SIGMAS standard deviations of the estimate below the threshold."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * (p * (1 - p) / k) ** 0.5 / (1 - chance)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of distinct ids. While they are few the ids are broadcast and no text is shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def wide_signatures(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, wide): packed signatures of WIDE further minima."""

    @lean
    def run(batches):
        for b in sliced(batches, 1):
            texts, keys = b.column(1).to_pylist(), b.column(0)
            for s, e, h, at in wordhash.many(texts):
                sets = [wordhash.shingles(h[x:y], words) for x, y in zip(at[:-1], at[1:])]
                for x, y in chunks([1] * len(sets), 256):  # WIDE minima of so many sets are 2 MB
                    m = minima(np.concatenate(sets[x:y]), np.cumsum([0, *map(len, sets[x : y - 1])]), K, WIDE)
                    yield pa.RecordBatch.from_arrays([keys[s + x : s + y], pa.array(packed(m).view(np.int64).tolist(), pa.list_(pa.int64()))], ["node", "wide"])

    return texts_of(ids, docs).select("doc_id", "text").mapInArrow(run, "node long, wide array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The distinct pairs (a, b) whose full sets have den * intersection >= num * union. docs: (doc_id, text).

    Each a meets its partners in groups of about GROUP; a row of each group is a itself.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "dup-pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("n")).cast("int"))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = texts_of(ids, docs)
    wanted = salted.select(F.col("b").alias("doc_id"), "a", "salt").union(
        salts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    )
    rows = wanted.join(texts, "doc_id").select("a", "salt", (F.col("doc_id") != F.col("a")).alias("other"), F.col("doc_id").alias("b"), "text")
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other")

    @lean
    def run(batches):
        group, head = None, None
        for batch in sliced(batches, 4):
            a, salt, other, b, text = (batch.column(i).to_pylist() for i in range(5))
            found_a, found_b = [], []
            for s, e, h, at in wordhash.many(text):
                for i in range(s, e):
                    mine = wordhash.shingles(h[at[i - s] : at[i - s + 1]], words)
                    if not other[i]:
                        if (a[i], salt[i]) != group:
                            group, head = (a[i], salt[i]), mine
                    elif (a[i], salt[i]) == group:
                        both = len(np.intersect1d(head, mine, assume_unique=True))
                        if den * both >= num * (len(head) + len(mine) - both):
                            found_a.append(a[i])
                            found_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    out = materialize(dealt.mapInArrow(run, "a long, b long").distinct(), "dup-links")
    release(pairs)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component): every linked node and the smallest node it can reach. links: (a, b)."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        done = materialize(nxt, "cc")
        release(edges)
        edges = done
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", F.col("v").alias("w")).distinct()
    )
    out._rondo_path = edges._rondo_path  # for release()
    return out


@dataclass
class Linked:
    """What linking gives: rows (doc_id, digest, n_shingles, set_hash, row), nodes (set_hash, node), links (a, b) of nodes."""

    rows: DataFrame
    nodes: DataFrame
    links: DataFrame
    #: doc_ids of several rows: (doc_id, lo, texts), texts being more than one if these differ.
    repeated: DataFrame
    several: bool
    held: list[DataFrame]

    def release(self) -> None:
        for df in self.held:
            release(df)


def _rows(sigs: DataFrame, body: DataFrame, repeated: DataFrame, held: list[DataFrame]) -> tuple[DataFrame, DataFrame, bool]:
    """sigs and body with the column row, which tells different texts apart, and whether any doc_id has several.

    A row is named by its doc_id; where a doc_id has several texts, those but one get a number that no doc_id has.
    """
    several = repeated.filter("texts > 1")
    if several.isEmpty():
        return sigs.withColumn("row", F.col("doc_id")), body.withColumn("row", F.col("doc_id")), False
    named = sigs.filter("doc_id is not null").select("doc_id", "digest")
    extra = named.join(several, "doc_id").filter(F.col("digest") != F.col("lo")).select("doc_id", "digest").distinct()
    held.append(extra := materialize(extra, "dup-extra"))
    low, high = named.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    number = F.lit(high) + 1 + number if high < 1 << 62 else F.lit(low) - 1 - number
    held.append(extra := materialize(extra.select("doc_id", "digest", number.alias("number")), "dup-numbers"))

    def name(df: DataFrame) -> DataFrame:
        return df.join(extra, ["doc_id", "digest"], "left").withColumn("row", F.coalesce("number", "doc_id")).drop("number")

    return name(sigs), name(body), True


def linked(docs: DataFrame, words: int, num: int, den: int, text: str, key: str) -> Linked:
    """Sets, nodes and confirmed links of all rows; connected nodes share a component of these links."""
    small_batches(docs.sparkSession)
    body = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), F.xxhash64(docs[text].cast("string")).alias("digest"))
    sigs = materialize(signatures(body, words), "dup-sigs")
    held = [sigs]
    repeated = sigs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    repeated = repeated.filter("n > 1").select("doc_id", "lo", F.when(F.col("lo") == F.col("hi"), 1).otherwise(2).alias("texts"))
    held.append(repeated := materialize(repeated, "dup-repeated"))
    rows, body, several = _rows(sigs, body, repeated, held)
    body = body.select(F.col("row").alias("doc_id"), "text")
    floor = floor_of(num / den)
    nodes = materialize(
        rows.filter("n_shingles > 0 and row is not null").groupBy("set_hash")
        .agg(F.min("row").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "dup-nodes",
    )
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(buckets.join(heads, "key").select("key", "band", "node", "head"), "dup-shared")
    sig = nodes.select("node", "sig", "bands")
    held += [nodes, shared]

    def near(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        with_b = with_a.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        return with_b.filter(estimate("sa", "sb") >= floor)

    def labels(links: DataFrame) -> DataFrame:
        """Three steps of propagation towards smaller nodes: all that labels must do is to spare pairs connected already."""
        lab = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
        for _ in range(2):
            up = links.join(lab.select(F.col("node").alias("a"), "component"), "a").select(F.col("b").alias("node"), "component")
            lab = lab.union(up).groupBy("node").agg(F.min("component").alias("component"))
        held.append(lab := materialize(lab, "dup-labels"))
        return lab

    inner = shared.filter("node != head")
    once = inner.groupBy(F.col("node").alias("b")).agg(F.min("head").alias("a")).select("a", "b")
    held.append(links := confirmed(near(once), body, words, num, den))
    first = labels(links)
    of_head = first.select(F.col("node").alias("head"), F.col("component").alias("other"))
    stars = inner.join(first, "node", "left").join(of_head, "head", "left").filter(F.coalesce("component", "node") != F.coalesce("other", "head"))
    stars = stars.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct().join(once, ["a", "b"], "left_anti")
    held.append(more := confirmed(near(stars), body, words, num, den))
    links = links.union(more)
    first = labels(links)
    tried = once.union(stars)
    at = shared.join(first, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("comp"))
    open_ = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi")
    rest = at.join(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    rest = materialize(rest, "dup-open")
    wide = materialize(wide_signatures(rest.select(F.col("node").alias("doc_id")).distinct(), body, words), "dup-wide")
    held += [rest, wide]
    rest = rest.join(sig, "node").join(wide, "node")
    rest = materialize(rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dup-rest")
    held.append(rest)
    left = rest.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("sig").alias("sa"), F.col("bands").alias("ha"), F.col("wide").alias("wa"), "band")
    right = rest.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("sig").alias("sb"), F.col("bands").alias("hb"), F.col("wide").alias("wb"))
    met = F.exists(F.zip_with(F.slice("ha", F.lit(1), F.col("band")), F.slice("hb", F.lit(1), F.col("band")), lambda x, y: x == y), lambda z: z)
    cross = left.join(
        right,
        (left.key == right.key) & (left.i == right.i) & (left.j == right.j) & (F.col("ca") != F.col("cb"))
        & ((left.i != left.j) | (F.col("a") < F.col("b"))) & (estimate("sa", "sb") >= floor) & ~met
        & (estimate("wa", "wb", WIDE) >= floor_of(num / den, WIDE)),
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Pairs of round one that were denied needn't be looked at again.
    held.append(again := confirmed(cross.distinct().join(tried, ["a", "b"], "left_anti"), body, words, num, den))
    return Linked(rows.select("doc_id", "digest", "n_shingles", "set_hash", "row"), nodes.select("set_hash", "node"), links.union(again), repeated, several, held)


def near_duplicates(docs: DataFrame, words: int = 4, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row: links at num/den Jaccard similarity or more."""
    d = linked(docs, words, num, den, text, key)
    links = d.links
    if d.several:  # the texts of one doc_id belong together
        own = d.rows.join(d.repeated.filter("texts > 1"), "doc_id", "left_semi").join(d.nodes, "set_hash", "left").select("doc_id", "row", "node")
        links = links.union(own.select("doc_id", "row")).union(own.filter("node is not null").select("row", "node"))
    label = components(links)
    d.held.append(label)
    placed = d.rows.join(d.nodes.join(label, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component")), "set_hash", "left")
    if d.several:  # numbers beyond the doc_ids may be labels
        least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        placed = placed.join(least, "component", "left").withColumn("component", F.col("least"))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = materialize(placed.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept")), "dup-result")
    d.release()
    return out


def deduplicate(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each near-duplicate component, that with the smallest key.

    Rows equal in key and text become one; rows that share a key but not the text are documents of their own. Null, empty
    and blank texts and rows without a key stay. Texts are shuffled for repeated keys only, and for an anti join if those
    that go are too many to broadcast.
    """
    d = linked(docs, words, num, den, text, key)
    label = components(d.links)
    d.held.append(label)
    of_set = d.nodes.join(label, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    placed = d.rows.filter("doc_id is not null").join(of_set, "set_hash").select("doc_id", "digest", "row", "component")
    if d.several:  # the smallest doc_id may have a number as its row
        first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"))
        gone = placed.join(first, "component").filter(F.col("row") != F.col("first.row"))
    else:  # a component is named by its smallest row
        gone = placed.filter(F.col("row") != F.col("component"))
    id_, hash_, other = fresh(docs, "doc_id", "digest", "other")
    gone = materialize(gone.select(F.col("doc_id").alias(id_), F.col("digest").alias(hash_)).distinct(), "dup-gone")
    again = materialize(d.repeated.select(F.col("doc_id").alias(other)), "dup-again")
    d.release()
    named = docs.withColumn(id_, docs[key].cast("long")).withColumn(hash_, F.xxhash64(docs[text].cast("string")))
    on = F.col(id_) == F.col(other)
    stay = named.join(gone, [id_, hash_], "left_anti") if d.several else named.join(gone.select(id_), id_, "left_anti")
    once = stay.join(again, on, "left_anti")
    if not again.isEmpty():
        once = once.union(stay.join(again, on, "left_semi").select(once.columns).dropDuplicates([id_, hash_]))
    return once.select(*docs.columns)
