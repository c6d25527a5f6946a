"""Language identification of mixed-language text (operator 7).

Words are runs of letters. The Unicode range of its first letter gives a word its script, which leaves only the languages that
use that script. Under each of these a word scores the log-likelihood of its letter trigrams (word boundaries
included), learned from labelled rows. A Viterbi pass over the words of a text, with a penalty for each switch, labels spans;
the text's language is the label with most letters, and its score is that label's share of the letters.

Training takes about MAX_DOCS rows of each language, drawn by a hash of the key: a bounded sample at any size.

Edge cases: null texts and texts without letters are `und` with score 0; without any training row every text is `und`;
rows without language or key don't train; repeated rows get equal answers; an empty table gives no rows; ties go to the
first language by code point; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget_others, forgettable, give_back, lean, sliced, small_batches

MAX_DOCS, BUCKETS, ALPHA, SWITCH = 4000, 1 << 16, 0.05, 14.0
#: Characters split at once, and word scores (words times languages) held for one Viterbi pass: 4 bytes each.
AT_ONCE, SCORES_AT_ONCE = 1 << 18, 1 << 21
#: Least share of a script among a language's training letters for the language to use it.
USES = 0.005
# First code points of Unicode's script ranges, in order; 0 is what no range holds.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, the index of its script."""
    n = sys.maxunicode + 1
    letter, lower, script = np.zeros(n, bool), np.arange(n, dtype=np.uint32), np.zeros(n, np.uint8)
    for c in range(0x32000):  # beyond lie no letters
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            letter[c] = True
            if len(x := ch.lower()) == 1:
                lower[c] = ord(x)
    for (a, name), (b, _) in zip(SCRIPTS, [*SCRIPTS[1:], (n, "")]):
        script[a:b] = NAMES.index(name)
    return letter, lower, script


forgettable(__name__, lambda: tables.cache_info().currsize, tables.cache_clear)


@dataclass
class Words:
    """The words of some texts: bucket of each trigram, first trigram of each word, and of each word begin, end, script, text."""

    grams: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    script: np.ndarray
    text: np.ndarray


def split(texts: list[str | None]) -> Words:
    letter, lower, script = tables()
    joined = "\n".join(t or "" for t in texts)
    p = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])])
    is_l = letter[p]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_l, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    at = np.flatnonzero(is_l)
    c = lower[p[at]].astype(np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    nth = np.arange(len(at)) - np.repeat(first, size)
    c1 = np.where(nth >= 1, np.concatenate([c[:1] * 0, c[:-1]]), 0).astype(np.uint64)
    c2 = np.where(nth >= 2, np.concatenate([c[:2] * 0, c[:-2]]), 0).astype(np.uint64)
    last = first + size - 1
    # One more gram closes each word.
    a, b, d = np.insert(c2, last + 1, c1[last]), np.insert(c1, last + 1, c[last]), np.insert(c, last + 1, 1)
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + d * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    grams = ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.int64)
    text = np.searchsorted(offsets, begin, side="right") - 1
    return Words(grams, first + np.arange(len(first)), begin - offsets[text], end - offsets[text], script[p[begin]], text)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (BUCKETS, languages) log-probabilities
    uses: np.ndarray  # (scripts, languages)

    def word_scores(self, w: Words) -> np.ndarray:
        s = np.add.reduceat(self.weight[w.grams], w.first, axis=0) if len(w.first) else np.zeros((0, len(self.langs)), np.float32)
        ok = self.uses[w.script]
        ok = ok | ~ok.any(axis=1, keepdims=True)  # a script that no language uses narrows nothing
        return np.where(ok, s, np.float32(-1e4))


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word; words bounds[i]:bounds[i + 1] are those of text i. All texts in step."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    begin, size = bounds[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")
    best_before = np.zeros(len(scores), np.int16)
    switched = np.zeros(scores.shape, bool)
    delta = np.zeros((len(size), scores.shape[1]))
    for t in range(steps):
        m = live[t]
        d, at = delta[:m], begin[:m] + t
        if t:
            arg = d.argmax(axis=1)
            top = d[np.arange(m), arg] - penalty
            sw = top[:, None] > d
            best_before[at], switched[at] = arg, sw
            d = np.where(sw, top[:, None], d)
        delta[:m] = d + scores[at]
    out = np.zeros(len(scores), np.int16)
    now = np.argmax(delta, axis=1)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at, k = begin[:m] + t, now[:m]
        out[at] = k
        now[:m] = np.where(switched[at, k], best_before[at], k)
    return out


def held_out(key) -> F.Column:
    """Rows that never train: CRC-32 of the key as text modulo 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_DOCS) -> Model:
    """Trigram counts of a bounded sample. At most BUCKETS counts per language reach the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("k")))
    sizes = {r["lang"]: r["n"] for r in rows.filter("text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, max_docs / n))).otherwise(share)
    sample = rows.filter((F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share * (1 << 20)) & F.col("text").isNotNull())

    @lean
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in sliced(batches, 0):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s, e in chunks([len(t) for t in texts], AT_ONCE):
                w = split(texts[s:e])
                per_word = np.diff(np.append(w.first, len(w.grams)))
                of = np.array([langs[s + i] for i in range(e - s)], object)[w.text]
                for name in set(langs[s:e]):
                    mine = of == name
                    c = counts.setdefault(name, np.zeros(BUCKETS + len(NAMES), np.int64))
                    c[:BUCKETS] += np.bincount(w.grams[np.repeat(mine, per_word)], minlength=BUCKETS)
                    c[BUCKETS:] += np.bincount(w.script[mine], (w.end - w.begin)[mine], minlength=len(NAMES)).astype(np.int64)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "at", "n"])

    got = sample.select("text", "lang").mapInArrow(run, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    for k, name in enumerate(langs):
        mine = got[got["lang"] == name]
        counts[k, mine["at"].to_numpy()] = mine["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logp = np.log((grams + ALPHA) / (grams.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))
    uses = scripts >= USES * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(logp.T, np.float32), uses.T.copy())


def label(model: Model, texts: list[str | None]):
    """Yield for each group of texts (start, stop, words, label of each word)."""
    if not model.langs:
        return
    held, start, total = [], 0, 0
    for s, e in chunks([len(t or "") for t in texts], max(1 << 14, AT_ONCE * 4 // max(4, len(model.langs)))):
        w = split(texts[s:e])
        # Trigrams go as soon as words are scored; what is held of a word is its score and place.
        held.append(((w.text + s - start).astype(np.int32), w.begin.astype(np.int32), w.end.astype(np.int32), model.word_scores(w)))
        total += len(w.first)
        del w
        if total * len(model.langs) >= SCORES_AT_ONCE or e == len(texts):
            text, begin, end, scores = (np.concatenate(x) for x in zip(*held))
            held = []
            bounds = np.searchsorted(text, np.arange(e - start + 1))
            yield start, e, text, begin, end, viterbi(scores, bounds)
            start, total = e, 0


def predict(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Index of each text's language (len(model.langs): und) and its share of the letters."""
    pred, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
    for s, e, owner, begin, end, best in label(model, texts):
        letters = np.zeros((e - s, len(model.langs)))
        np.add.at(letters, (owner, best), end - begin)
        total = letters.sum(axis=1)
        some = total > 0
        pred[s:e][some] = letters[some].argmax(axis=1)
        score[s:e][some] = letters[some].max(axis=1) / total[some]
    return pred, score


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    names = pa.array([*model.langs, "und"])

    @lean
    def run(batches):
        for b in sliced(batches, 2):
            pred, score = predict(model, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names.take(pa.array(pred)), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key]).alias("held_out"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_of(model: Model):
    """A column function: the language of a text, or und. Declared nondeterministic, so that no plan evaluates it twice a row."""
    names = np.array([*model.langs, "und"], object)

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        forget_others(__name__)
        out = pd.Series(names[predict(model, texts.where(texts.notna(), None).tolist())[0]])
        give_back()
        return out

    return found.asNondeterministic()


def spans(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, lang): runs of words with one label, in code points."""

    @lean
    def run(batches):
        for b in sliced(batches, 1):
            keys, texts = b.column(0), b.column(1).to_pylist()
            for s, _, owner, begin, end, best in label(model, texts):
                if not len(best):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(best) != 0)]))
                last = np.append(first[1:], len(best)) - 1
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner[first] + s)), pa.array(begin[first], pa.int64()), pa.array(end[last], pa.int64()), pa.array([model.langs[k] for k in best[first]])],
                    ["doc_id", "start", "end", "lang"],
                )

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, lang string")
