"""Byte-level BPE by the tokenizers library, one call per distinct word instead of one per occurrence.

The splitting pattern of byte-level BPE always starts a new piece at a single space between two non-space characters (the
space goes with what follows) and makes a lone newline between two such characters a piece of its own. So the ids
of a text are those of its words, each with its space, one after another, and the library's answer for a word can be
kept. Other white space stays inside the words that the library gets; texts with a special token's string go to it whole.

Texts are taken many at a time: Arrow tells their different words, each is looked up once, and NumPy lays the ids out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa

from .common import forgettable

#: Words kept per process in each of two generations, some 200 bytes each: bounded memory, whatever the vocabulary.
CACHE = 300_000
#: Marks of words seen before; only on second sight a word is kept, so that the many that occur once don't crowd out others.
SEEN = 1 << 21
#: Longer words are encoded anew each time.
LONGEST = 40
#: Words whose ids are laid out at once.
AT_ONCE = 1 << 18
#: Trailing characters that the pattern always parts from a letter or digit before them.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_odd_space = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: How the vocabulary writes the byte of a space.
SPACE = "\u0120"
#: Stands before punctuation that has no space before it; a text that holds it goes to the library whole.
MARK = "\x02"
COMMA, STOP = f" {MARK}, ", f" {MARK}. "
_glued = re.compile(f"{MARK}(?<![^\\W_] {MARK})").search  # looks back from the mark, which is found fast
_between = re.compile(r"(?<=\S) (?=\S)").split


def _marked(text: str) -> str | None:
    """A text that isn't empty with one space between its words; a word at the begin of the text or of a line has a newline before it.

    None if any white space isn't single.
    """
    odd = any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") if text.isascii() else _odd_space(text)
    if odd or text[0] in " \n" or text[-1] in " \n" or any(c in text for c in ("  ", "\n\n", " \n", "\n ")):
        return None
    text = "\n" + text.replace("\n", " \n")
    # A stop or comma behind a letter or digit is a piece of its own: a word by itself, so that fewer different words remain.
    marked = text.replace(", ", COMMA).replace(". ", STOP)
    return text if _glued(marked) else marked


def _distinct(marked: list[str]) -> tuple[np.ndarray, list[str]]:
    """The different words of these texts, and the number of each word of theirs, in order."""
    raw = f" {' '.join(marked)}".encode()
    # Each word with the space before it: what one space and the next enclose, without a copy.
    begins = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    ends = pa.py_buffer(np.append(begins, len(raw)).astype(np.int64))
    coded = pa.LargeStringArray.from_buffers(len(begins), ends, pa.py_buffer(raw)).dictionary_encode()
    _, ends, said = coded.dictionary.buffers()
    last = np.frombuffer(ends, np.int64)[len(coded.dictionary)]
    return coded.indices.to_numpy(), said[:last].to_pybytes().decode()[1:].split(" ")


class WordEncoder:
    """ids(texts): for each text, the ids that the library's encode(text, add_special_tokens=False) gives."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.size, bool)  # ids whose bytes begin with a space
        self.spaced[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t[0] == SPACE]] = True
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.limit = cache
        self.words: dict[str, bytes] = {}  # ids of a word with the space, or the newline, before it
        self.older: dict[str, bytes] = {}  # the generation before
        self.seen = np.zeros(SEEN, bool)
        self.tails: dict[str, bytes] = {}
        self.newline = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode_all(self, words: list[str]) -> Iterable[bytes]:
        """The ids of each word by itself, in order."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            n = np.bincount(np.asarray(e.word_ids, np.int64), minlength=len(part))
            yield from self._cut(np.asarray(e.ids, self.dtype), np.cumsum(n))

    def _encode_letters(self, words: list[str]) -> Iterable[bytes]:
        """The ids of words of letters alone, each with the space before it: pieces of their own in one text.

        The fast call, without offsets, doesn't say which word an id is of: a word's first id is the one that begins with a space.
        """
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            e = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(e.ids, self.dtype)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(part):
                raise ValueError("a word of letters isn't a piece of its own")
            yield from self._cut(ids, np.append(begins[1:], len(ids)))

    def _cut(self, ids: np.ndarray, ends: np.ndarray) -> Iterable[bytes]:
        raw, begin = ids.tobytes(), 0
        for end in (ends * self.dtype.itemsize).tolist():
            yield raw[begin:end]
            begin = end

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't kept."""
        older = self.older
        out = {w: older[w] for w in new if w in older}
        old = list(out)
        ended: list[tuple[str, str]] = []
        todo: set[str] = set()
        for w in new.difference(out):
            core = w.rstrip(PUNCTUATION)
            if core and len(core) < len(w) and (core[-1].isalpha() or core[-1].isdecimal()):
                ended.append((w, core))
                w = core
                if w in out:
                    continue
                ids = self.words.get(w) or older.get(w)
                if ids is not None:
                    out[w] = ids
                    continue
            todo.add(w)
        letters = [w for w in todo if w.isalpha()]
        out.update(zip(letters, self._encode_letters(letters)))
        todo.difference_update(letters)
        marks = [w for w in todo if w[0] == MARK]
        out.update(zip(marks, self._encode_all([w[1:] for w in marks])))
        todo.difference_update(marks)
        spaced = [w for w in todo if w[0] != "\n"]
        out.update(zip(spaced, self._encode_all([" " + w for w in spaced])))
        heads = [w for w in todo if w[0] == "\n"]
        out.update(zip(heads, [self.newline + x for x in self._encode_all([w[1:] for w in heads])]))
        tails = list({w[len(core):] for w, core in ended}.difference(self.tails))
        if len(self.tails) > self.limit:
            self.tails = {w[len(core):]: self.tails[w[len(core):]] for w, core in ended if w[len(core):] in self.tails}
        self.tails.update(zip(tails, self._encode_all(tails)))
        for w, core in ended:
            out[w] = out[core] + self.tails[w[len(core):]]
        self._keep(old, out)
        return out

    def _keep(self, old: list[str], out: dict[str, bytes]) -> None:
        """Keep the words of the older generation and those seen before, a whole word and its part without punctuation alike."""
        short = [w for w in out if len(w) <= LONGEST]
        slot = np.fromiter(map(hash, short), np.int64, len(short)) & (SEEN - 1)
        again = [*old, *compress(short, self.seen[slot].tolist())]
        self.seen[slot] = True
        if len(self.words) + len(again) > self.limit:
            self.older, self.words = self.words, {}
            self.seen[:] = False
            again = again[: self.limit]
        self.words.update((w, out[w]) for w in again)

    def _find(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        found = list(map(self.words.get, words))
        if None in found:
            gaps = [k for k, x in enumerate(found) if x is None]
            new = self._learn({words[k] for k in gaps})
            for k in gaps:
                found[k] = new[words[k]]
        return found

    def _laid_out(self, marked: list[str]) -> Iterable[np.ndarray]:
        """The ids of each text."""
        codes, words = _distinct(marked)
        found = self._find(words)
        ids = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        flat = []
        for at in range(0, len(codes), AT_ONCE):
            part = codes[at : at + AT_ONCE]
            n = size[part]
            before = np.cumsum(n) - n
            flat.append(ids[np.repeat(first[part] - before, n) + np.arange(int(n.sum()))])
        out = np.concatenate(flat)
        ends, begin, skip = np.cumsum(size[codes]), 0, len(self.newline) // self.dtype.itemsize
        for last in np.cumsum([t.count(" ") + 1 for t in marked]).tolist():
            end = int(ends[last - 1])
            yield out[begin + skip : end]
            begin = end

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        marked: list[str] = []
        split: list[tuple[int, int]] = []  # texts with other white space: words hold the rest of it, lines included
        words: list[str] = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, self.dtype)
            elif MARK in t or self.special(t):
                out[i] = np.frombuffer(self._encode(t), self.dtype)
            elif m := _marked(t):
                plain.append(i)
                marked.append(m)
            else:
                words += _between("\n" + t)
                split.append((i, len(words)))
        if plain:
            for i, x in zip(plain, self._laid_out(marked)):
                out[i] = x
        found, begin, skip = self._find(words), 0, len(self.newline)
        for i, end in split:
            out[i] = np.frombuffer(b"".join(found[begin:end]), self.dtype, offset=skip)
            begin = end
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One encoder per process and file."""
    return WordEncoder(path)


forgettable(__name__, lambda: encoder.cache_info().currsize, encoder.cache_clear)
