"""Benchmark decontamination by latent semantic retrieval (operator 8).

1. Terms are the words of the benchmark (punctuation dropped, lower-cased). Every document is cut into blocks of BLOCK
   words; in how many blocks a term occurs gives its inverse frequency, over all documents.
2. Blocks of all documents are the rows of a TF-IDF matrix A. Each task multiplies its part of A with a random matrix and
   back, Z = A' A R, and the sum of Z gives singular vectors and values by the Nystrom formula: a distributed randomised SVD.
3. Passages are runs of blocks at every block boundary, in several lengths. Each is compared with every benchmark item of about its
   length by cosine in the latent space; passages at COSINE or more are candidates.
4. A candidate that shares enough TF-IDF weight of rare terms with the item is aligned with it, words around it included: the longest
   common subsequence must cover NEAR of the item's words, or PARAPHRASE of them where the item's rarest terms, which
   hold the answer, are there too.

Items of under SHORT words have no passage of their own; they are found as exact runs of all their words.

The benchmark is a stated query set; AT_MOST of its words are held by every task at a time, a larger one is searched in
several passes. Nothing of the corpus is held but one row of Z per benchmark term. Longer items are cut into items
of at most LONGEST words, each checked by itself.

Edge cases: null and empty texts give no match; null or empty benchmark items are passed over; items that share an
id are each checked, and a document matches an id once; without benchmark or documents nothing matches; repeated rows match alike;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import forget_others, give_back, lean, n_words, sliced, small_batches

BLOCK, RANK, SPANS, ROWS_AT_ONCE = 12, 32, (2, 4, 6), 2000
COSINE, SHARED, NEAR, PARAPHRASE = 0.4, 0.4, 0.75, 0.5
#: Inverse frequency from which a term counts as rare (in one block of 400 or fewer); only rare terms make shared weight.
RARE = 6.0
ANSWER_TERMS, ANSWER_SHARE, LONGEST, SHORT = 4, 0.75, 60, 6
#: Words of the benchmark held at once; a larger one is searched in several passes. Items, and cells of passages by items, at once.
AT_MOST, ITEMS_AT_ONCE, CELLS = 200_000, 1024, 1 << 21
_rng_seed = 11
#: Punctuation counts as white space: that of ASCII, and in UTF-8 Latin-1's signs, general punctuation, currencies, arrows to symbols, CJK's.
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_SIGNS = re.compile(
    rb"\xc2[\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf]|\xc3[\x97\xb7]|\xe2(?:\x80[\x80-\xbf]|\x81[\x80-\xaf]|\x82[\xa0-\xbf]|\x86[\x90-\xbf]|[\x87-\xaf][\x80-\xbf])"
    rb"|\xe3\x80[\x80-\xbf]|\xef(?:\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xbd[\x80\x9b-\xa5])"
)


def plain(text: str | None) -> bytes:
    """UTF-8 of a text in lower case, with punctuation as spaces."""
    if not text:
        return b""
    if text.isascii():  # wordhash lower-cases A-Z
        return text.encode().translate(_PLAIN)
    return _SIGNS.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN))


def word_lists(texts: list[str | None]):
    """Yield (start, stop, hashes, bounds) as wordhash.many does, punctuation dropped."""
    return wordhash.many_bytes([plain(t) for t in texts])


@dataclass
class Items:
    """Benchmark items as term numbers; terms are sorted word hashes."""

    ids: list
    terms: np.ndarray
    words: list[np.ndarray]

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        hit = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.terms, h[hit]), len(self.terms) - 1)
            ok = self.terms[at] == h[hit]
            out[hit[ok]] = at[ok]
        return out


def read_items(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> Items:
    """The stated query set, on the driver; build() sees to it that it is bounded."""
    rows = benchmark.select(benchmark[key].alias("k"), benchmark[text].cast("string").alias("t")).filter("t is not null and k is not null").orderBy("k", "t").collect()
    ids, hashes = [], []
    for s, e, h, at in word_lists([r["t"] for r in rows]):
        for i in range(s, e):
            w = h[at[i - s] : at[i - s + 1]]
            parts = np.array_split(w, -(-len(w) // LONGEST)) if len(w) else []
            for p in parts:
                ids.append(rows[i]["k"])
                hashes.append(p)
    terms = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
    return Items(ids, terms, [np.searchsorted(terms, h).astype(np.int32) for h in hashes])


def _blocks(items: Items, h: np.ndarray, at: np.ndarray):
    """Term and block number of each word that is a term; first block of each text."""
    n = np.diff(at)
    first = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])
    term = items.lookup(h)
    hit = np.flatnonzero(term >= 0)
    text = np.searchsorted(at, hit, side="right") - 1
    return term[hit], first[text] + (hit - at[text]) // BLOCK, first


@dataclass
class Space:
    """Inverse frequencies and the latent space."""

    idf: np.ndarray
    basis: np.ndarray  # (terms, rank), scaled so that a product with it gives latent coordinates
    values: np.ndarray


def _rows(batch, column: int = 0):
    return batch.column(column).to_pylist()


def fit(docs: DataFrame, items: Items, text: str = "text", rank: int = RANK) -> Space:
    """Block frequencies, then the randomised SVD, each in one pass over all documents."""
    body = docs.select(docs[text].cast("string").alias("text"))
    m = len(items.terms)

    @lean
    def frequencies(batches):
        df, total = np.zeros(m, np.int64), 0
        for b in sliced(batches, 0):
            for _, _, h, at in word_lists(_rows(b)):
                term, block, first = _blocks(items, h, at)
                total += int(first[-1])
                df += np.bincount(np.unique(block.astype(np.int64) * m + term) % m, minlength=m)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int64()), pa.array([*df[some].tolist(), total], pa.int64())], ["term", "n"])

    df, total = np.zeros(m, np.int64), 0
    if m:
        for t, n in body.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            if t < 0:
                total = n
            else:
                df[t] = n
    idf = np.log((total + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    r = min(rank, m)
    test = np.random.default_rng(_rng_seed).standard_normal((m, r)).astype(np.float32)

    @lean
    def sketch(batches):
        z = np.zeros((m, r), np.float32)
        for b in sliced(batches, 0):
            for _, _, h, at in word_lists(_rows(b)):
                term, block, first = _blocks(items, h, at)
                if not len(term):
                    continue
                start = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0]))
                w = idf[term]
                norm = np.sqrt(np.add.reduceat(w * w, start))
                w = w / np.repeat(norm, np.diff(np.append(start, len(term))))
                y = np.add.reduceat(test[term] * w[:, None], start, axis=0)
                of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
                order = np.argsort(term, kind="stable")
                t = term[order]
                seg = np.flatnonzero(np.concatenate([[True], np.diff(t) != 0]))
                z[t[seg]] += np.add.reduceat(y[of[order]] * w[order, None], seg, axis=0)
        some = np.flatnonzero(z.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([x.tolist() for x in z[some]], pa.list_(pa.float64()))], ["term", "z"])

    z = np.zeros((m, r))
    if m and total:
        parts = [F.sum(F.col("z")[k]).alias(f"z{k}") for k in range(r)]
        for row in body.mapInArrow(sketch, "term long, z array<double>").groupBy("term").agg(*parts).collect():
            z[row[0]] = row[1:]
    # Nystrom: A'A ~ Z (R'Z)^-1 Z'.
    core = test.T.astype(np.float64) @ z
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core) if r else (np.empty(0), np.empty((0, 0)))
    good = val > max(1e-9, 1e-7 * (val.max() if r else 0))
    u, s, _ = np.linalg.svd(z @ (vec[:, good] / np.sqrt(val[good])), full_matrices=False) if good.any() else (np.zeros((m, 0)), np.zeros(0), None)
    return Space(idf, u.astype(np.float32), s.astype(np.float32))


def lcs(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = where.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Checker:
    """Finds benchmark items in texts."""

    def __init__(self, items: Items, space: Space):
        self.items, self.space = items, space
        usable = [k for k, w in enumerate(items.words) if len(w) >= SHORT and space.basis.shape[1]]
        # Short items by their length, and the hash of all their words.
        self.short = [(n, np.array(ks), self._runs(np.concatenate([items.words[k] for k in ks]), np.arange(0, n * len(ks), n), n)) for n in range(1, SHORT) if (ks := [k for k, w in enumerate(items.words) if len(w) == n])]
        self.begins = np.zeros(len(items.terms), bool)
        self.begins[[items.words[k][0] for _, ks, _ in self.short for k in ks]] = True
        self.groups = []  # (blocks of a passage, item numbers, unit vectors)
        for n, blocks in enumerate(SPANS):
            low = SPANS[n - 1] * BLOCK if n else 0
            mine = [k for k in usable if low < len(items.words[k]) + BLOCK // 2 <= blocks * BLOCK or (n == len(SPANS) - 1 and len(items.words[k]) + BLOCK // 2 > blocks * BLOCK)]
            for part in (mine[x : x + ITEMS_AT_ONCE] for x in range(0, len(mine), ITEMS_AT_ONCE)):
                v = np.stack([self._vector(items.words[k]) for k in part])
                self.groups.append((blocks, np.array(part), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))
        rare = space.idf >= RARE
        self.total = np.array([float((space.idf * rare)[np.unique(w)].sum()) for w in items.words])
        self.answer = [w[np.sort(np.unique(w, return_index=True)[1])] for w in items.words]
        self.answer = [a[np.argsort(-space.idf[a], kind="stable")[:ANSWER_TERMS]] for a in self.answer]
        self.lists = [w.tolist() for w in items.words]
        m = len(items.terms)
        pairs = np.array([(t, k) for k in usable for t in np.unique(items.words[k]) if rare[t]], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.item_of, self.from_ = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(m + 1))

    def _vector(self, words: np.ndarray) -> np.ndarray:
        return (self.space.basis[words] * self.space.idf[words, None]).sum(axis=0)

    def find(self, texts: list[str | None]) -> list[tuple[int, object, float, int, int, int]]:
        """(text number, item id, cosine, longest common subsequence, item's words, answer terms found)."""
        out = []
        if not self.groups and not self.short:
            return out
        for s, _, h, at in word_lists(texts):
            best: dict[tuple[int, object], tuple] = {}
            if self.short:
                self._find_short(h, at, best)
            if self.groups:
                term, block, first = _blocks(self.items, h, at)
                if len(term):
                    self._find(h, at, term, block, first, best)
            out += [(s + i, k, *v) for (i, k), v in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]
        return out

    @staticmethod
    def _runs(terms: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n terms from each place on."""
        h = np.full(len(begin), n, np.uint64)
        for k in range(n):
            h = wordhash.mix(h * np.uint64(0x9E3779B97F4A7C15) + terms[begin + k].astype(np.int64).view(np.uint64))
        return h

    def _find_short(self, h, at, best) -> None:
        """Items under SHORT words: exact runs of all their words."""
        term = self.items.lookup(h)
        start = np.flatnonzero(term >= 0)
        start = start[self.begins[term[start]]]
        text = np.searchsorted(at, start, side="right") - 1
        for n, ks, keys in self.short:
            inside = start + n <= at[text + 1]
            begin = start[inside]
            runs = self._runs(term, begin, n)
            for x in np.flatnonzero(np.isin(runs, keys)).tolist():
                for k in ks[keys == runs[x]].tolist():
                    if (term[begin[x] : begin[x] + n] == self.items.words[k]).all():
                        best.setdefault((int(text[inside][x]), self.items.ids[k]), (1.0, n, n, len(self.answer[k])))

    def _find(self, h, at, term, block, first, best) -> None:
        n_blocks = int(first[-1])
        idf, basis = self.space.idf, self.space.basis
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        count = self.from_[term + 1] - self.from_[term]
        which = np.repeat(np.arange(len(term)), count)
        item = self.item_of[np.repeat(self.from_[term], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        heavy = np.concatenate([[0], np.cumsum(np.bincount(block, idf[term] * (idf[term] >= RARE), minlength=n_blocks))])
        for blocks, mine, unit in self.groups:
            a = np.arange(n_blocks)
            b = np.minimum(a + blocks, first[text_of + 1])
            # A passage whose rare terms weigh less than any item asks for can't match; the others are searched.
            live = np.flatnonzero(heavy[b] - heavy[a] >= SHARED * self.total[mine].min() * (1 - 1e-9))
            if not len(live):
                continue
            needed = np.zeros(n_blocks, bool)
            for k in range(blocks):
                needed[np.minimum(live + k, n_blocks - 1)] = True
            some = needed[block]
            tb, tt = block[some], term[some]
            y = np.zeros((n_blocks + 1, basis.shape[1]))
            if len(tb):
                start = np.flatnonzero(np.concatenate([[True], np.diff(tb) != 0]))
                y[tb[start] + 1] = np.add.reduceat(basis[tt] * idf[tt, None], start, axis=0)
            sums = np.cumsum(y, axis=0)
            v = (sums[b[live]] - sums[live]).astype(np.float32)
            unit_v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            column = np.full(len(self.items.words), -1)
            column[mine] = np.arange(len(mine))
            keep = column[item] >= 0
            w, t, c = which[keep], term[which[keep]], column[item[keep]]
            # A term lies in the passages that begin at its block or up to blocks - 1 before, in the same text. One that
            # occurs twice in a passage may count twice here; the alignment below decides.
            begin = block[w][:, None] - np.arange(blocks)
            begin = np.where(begin >= first[text_of[block[w]]][:, None], begin, -1)
            row = np.full(n_blocks + 1, -1)
            step = max(1, CELLS // len(mine))
            for lo in range(0, len(live), step):
                part = live[lo : lo + step]
                cos = unit_v[lo : lo + step] @ unit.T
                # Weight that each candidate shares with its item: terms of the passage, spread to the items that have them.
                row[:] = -1
                row[part] = np.arange(len(part))
                p = row[begin]  # -1 of begin is the spare last place
                ok = p >= 0
                cell = p * len(mine) + c[:, None]
                weight = np.bincount(cell[ok], np.broadcast_to(idf[t][:, None], p.shape)[ok], minlength=len(part) * len(mine)).reshape(len(part), len(mine))
                rows, cols = np.nonzero((cos >= COSINE) & (weight >= SHARED * self.total[mine]))
                self._align(h, at, first, text_of, blocks, [(int(part[r]), int(mine[c]), float(cos[r, c])) for r, c in zip(rows.tolist(), cols.tolist())], best)

    def _align(self, h, at, first, text_of, blocks, candidates, best) -> None:
        """Align candidates (first block of the passage, item, cosine) and keep the best of each text and item that hold."""
        tried = set()
        for p, k, cosine in candidates:
            i, n = int(text_of[p]), len(self.lists[k])
            lo, hi = at[i] + (p - first[i]) * BLOCK - n, at[i] + (p - first[i] + blocks) * BLOCK + n
            name = (i, self.items.ids[k])
            if (i, k, p // 2) in tried and best.get(name, (0, 0))[1] >= n:
                continue
            tried.add((i, k, p // 2))
            words = self.items.lookup(h[max(lo, at[i]) : min(hi, at[i + 1])])
            words = words[words >= 0]
            common = lcs(self.lists[k], words.tolist())
            answer = int(np.isin(self.answer[k], words).sum())
            if common >= NEAR * n or common >= PARAPHRASE * n and answer >= ANSWER_SHARE * len(self.answer[k]):
                found = (cosine, common, n, answer)
                if name not in best or (found[1] / found[2], found[0]) > (best[name][1] / best[name][2], best[name][0]):
                    best[name] = found


def build(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", at_most: int = AT_MOST) -> list[Checker]:
    """One checker for every at_most words of the benchmark, so that what is held stays bounded whatever its size."""
    small_batches(docs.sparkSession)
    words = benchmark.agg(F.sum(n_words(benchmark["text"]))).first()[0] or 0
    parts = -(-words // at_most) or 1
    out = []
    for k in range(parts):
        mine = benchmark if parts == 1 else benchmark.filter(F.pmod(F.xxhash64(benchmark[item_key], benchmark["text"]), F.lit(parts)) == k)
        items = read_items(mine, "text", item_key)
        out.append(Checker(items, fit(docs, items, text)))
    return out


def matches(docs: DataFrame, checkers: list[Checker], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, cosine, common, item_words, answer_terms): one row for each document and item found in it."""

    def search(checker: Checker) -> DataFrame:
        @lean
        def run(batches):
            for b in sliced(batches, 1):
                keys, texts = b.column(0), b.column(1)
                for s in range(0, len(texts), ROWS_AT_ONCE):
                    found = checker.find(texts[s : s + ROWS_AT_ONCE].to_pylist())
                    cols = list(zip(*found)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array([s + i for i in cols[0]], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], [pa.int64(), pa.float64(), *[pa.int64()] * 3])]],
                        ["doc_id", "item_id", "cosine", "common", "item_words", "answer_terms"],
                    )

        return body.mapInArrow(run, "doc_id long, item_id long, cosine double, common long, item_words long, answer_terms long")

    body = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    out = search(checkers[0])
    for checker in checkers[1:]:
        out = out.union(search(checker))
    return out.dropDuplicates(["doc_id", "item_id"])


def uncontaminated(docs: DataFrame, checkers: list[Checker], text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no benchmark item."""
    for checker in checkers:
        docs = docs.filter(~_holds(checker)(docs[text].cast("string")))
    return docs


def _holds(checker: Checker):
    """A column function: whether a text holds a benchmark item."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        forget_others(__name__)
        out = np.zeros(len(texts), bool)
        for i, *_ in checker.find(texts.where(texts.notna(), None).tolist()):
            out[i] = True
        give_back()
        return pd.Series(out)

    return found.asNondeterministic()
