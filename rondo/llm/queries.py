"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from .common import table
from .decontam import build, matches
from .fst_tokens import count_tokens
from .html_content import main_texts
from .langid import identify, train
from .mixing import mix_sources
from .mpeg import digests as audio_digests
from .neardup import near_duplicates
from .secret_scan import scan_digests
from .token_output import read_tokens, write_tokens
from .sharding import shard_by_bytes


def public_tokenizer(name: str) -> str:
    """Path of a public vocabulary file on this machine; every machine has them in the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans(spark, sf_dir):
    """Token ids in interleaved rANS segments, written in doc_id order, read back and digested."""
    segments, freq = write_tokens(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))
    return read_tokens(segments, freq, digest=True)


def op2_neardup(spark, sf_dir):
    """Near-duplicate components by b-bit MinHash, confirmed on full sets."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_html(spark, sf_dir):
    """Main text of every page, by marginals of a tree-structured model."""
    return main_texts(table(spark, sf_dir, "pages"))


def op4_count(spark, sf_dir):
    """Tokens of every text by the compiled finite-state tokenizer."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op5_mpeg(spark, sf_dir):
    """Texts stored as MPEG audio streams, read back, checked and digested."""
    return audio_digests(table(spark, sf_dir, "documents"))


def op6_secrets(spark, sf_dir):
    """Spans of secrets: three fixed patterns and inferred credential grammars."""
    return scan_digests(table(spark, sf_dir, "documents"))


def op7_langid(spark, sf_dir):
    """Language of every text: script ranges, word scores, Viterbi with a switching penalty."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op8_decontam(spark, sf_dir):
    """Documents and the benchmark items found in them, by latent semantic retrieval and alignment."""
    docs = table(spark, sf_dir, "documents")
    return matches(docs, build(docs, table(spark, sf_dir, "benchmark")))


def op9_mix(spark, sf_dir):
    """Words that the mix takes of each document, by hash-threshold histograms."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_shard(spark, sf_dir):
    """Eight contiguous shards of near-equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS u FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (source_size * 3)::DOUBLE AS cap,
             ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM by_source),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap
         ELSE (SELECT arg_min(level, cap / w) FROM l WHERE cap > level * w) * w END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
h AS (SELECT source, u, sum(size)::BIGINT AS n FROM d GROUP BY source, u),
c AS (SELECT source, u, n, sum(n) OVER (PARTITION BY source ORDER BY u) AS c FROM h),
k AS (SELECT c.source, c.u, ((target - whole * source_size) > 0 AND (c.c <= target - whole * source_size
         OR (c.c - c.n <= target - whole * source_size AND (target - whole * source_size - (c.c - c.n)) * 2 >= c.n))) AS more
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, ((p.whole + k.more::INT) * d.size)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.u = k.u
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM s),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.h = y.h AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(c.b, doc_id)) AS component_id, doc_id <= coalesce(c.b, doc_id) AS kept
FROM s LEFT JOIN c ON doc_id = c.a
"""

# The CRC table follows from its polynomial, and a text's CRC from its bytes one after another.
OP10_SQL = r"""
WITH tab AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) q(i)),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS h,
        list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes FROM documents),
k AS (SELECT doc_id, size, h, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM d, tab),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        row_number() OVER (ORDER BY h, doc_id NULLS FIRST, size) - 1 AS rn, (sum(size) OVER ())::BIGINT AS total FROM k),
g AS (SELECT h, min(start) AS a, sum(size)::BIGINT AS n FROM o GROUP BY h),
i AS (SELECT DISTINCT total, (total * j + 7) // 8 AS cut FROM o, range(1, 8) q(j)),
c AS (SELECT CASE WHEN h IS NULL OR n * 800 > total THEN cut WHEN cut - a <= a + n - cut THEN a ELSE a + n END AS cut FROM i LEFT JOIN g ON cut > a AND cut < a + n),
p AS (SELECT o.*, (SELECT count(*) FROM c WHERE c.cut <= o.start) AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INT AS shard, (rn - min(rn) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""

QUERIES = {"op1_rans": op1_rans, "op2_neardup": op2_neardup, "op3_html": op3_html, "op4_count": op4_count, "op5_mpeg": op5_mpeg, "op6_secrets": op6_secrets, "op7_langid": op7_langid, "op8_decontam": op8_decontam, "op9_mix": op9_mix, "op10_shard": op10_shard}
SQL = {"op2_neardup": OP2_SQL, "op9_mix": OP9_SQL, "op10_shard": OP10_SQL}
