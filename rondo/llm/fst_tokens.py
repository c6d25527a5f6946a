"""Token counts by finite-state tokenizer compilation (operator 4).

A byte-pair tokenizer with word ends is compiled, lazily, into a deterministic transducer over the characters of the
normalised text. Splitting into pieces (contractions, letters, single numbers, other characters; white space dropped)
is part of the same machine, and each transition is annotated with the net number of tokens it emits.

Why that is finite: in a byte-pair encoding, the encodings of the prefixes of a piece differ only in their last tokens, and
a sequence is the encoding of its text just if each two neighbours are (each pair encodes to itself). So the last token
of the next prefix is the one suffix token that gets on with the last token of the prefix before it. A state needs only
the suffixes that some vocabulary entry may still extend, the last token before each, and the counts there relative to
the present one. Two histories with equal states are one state.

Long texts are cut into chunks anywhere. The map of a chunk, from entry state to exit state and tokens, is a short head
(up to the first white space, after which all entry states agree), a count and an exit state; such maps form a monoid
under composition, and a prefix scan over a text's chunks gives its count. All chunks of a batch run in step with each
other on NumPy arrays.

Edge cases: a null or empty text has no bytes and no tokens; special tokens' strings inside a text count one each, as by
the library's default; characters beyond the transition table's alphabet and states beyond its room (it is emptied
then, as lazy automata do) change speed, not results; repeated rows get equal counts; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, forgettable, lean, sliced

END = "</w>"
#: Characters with columns of their own in the table; rows of the table; characters of a chunk; characters run at once.
ALPHABET, ROOM, CHUNK, AT_ONCE = 112, 140_000, 2048, 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
# The contractions of the splitting pattern, and Unicode's White_Space characters.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or 256 + n for the n-th other."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Bpe:
    """The vocabulary as a trie over bytes, with failure links, and which neighbours get on."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.chars = byte_characters()
        code = {c: b for b, c in enumerate(self.chars)}
        self.agree: dict[tuple[str, str], bool] = {}
        self.child: dict[int, int] = {}
        self.fail, self.depth, self.inner, self.final = [0], [0], [None], [None]
        whole = set(self.chars) | {c + END for c in self.chars} | {a + b for a, b in pairs}
        for t in sorted(whole):
            body = t.removesuffix(END)
            if not body or any(c not in code for c in body) or self._merge(self.atoms(t)) != [t]:
                continue  # a token that its own text doesn't encode to never occurs
            s = 0
            for c in body:
                k = s << 8 | code[c]
                if k not in self.child:
                    self.child[k] = len(self.fail)
                    self.fail.append(0)
                    self.depth.append(self.depth[s] + 1)
                    self.inner.append(None)
                    self.final.append(None)
                s = self.child[k]
            if t.endswith(END):
                self.final[s] = t
            else:
                self.inner[s] = t
        for k in sorted(self.child, key=lambda k: self.depth[self.child[k]]):
            s, b = k >> 8, k & 255
            if s:
                self.fail[self.child[k]] = self.step(self.fail[s], b)

    def atoms(self, t: str) -> list[str]:
        body = t.removesuffix(END)
        return [*body[:-1], body[-1] + END] if t.endswith(END) else list(body)

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging by rank, leftmost first."""
        parts, rank = list(parts), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), sys.maxsize))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def step(self, s: int, b: int) -> int:
        """Longest suffix that is still a prefix of an entry, after one more byte."""
        while True:
            t = self.child.get(s << 8 | b)
            if t is not None:
                return t
            if not s:
                return 0
            s = self.fail[s]

    def gets_on(self, a: str, b: str) -> bool:
        k = a, b
        known = self.agree.get(k)
        if known is None:
            known = self.agree[k] = self._merge(self.atoms(a) + self.atoms(b)) == [a, b]
        return known


# A piece in progress is (trie node, ((length, last token before it, relative count), ...), tokens if it ended here):
# lengths of the live suffixes, longest first, 0 last. None as last token: the suffix is all of the piece.
START = (0, ((0, None, 0),), 0)


def advance(bpe: Bpe, piece: tuple, byte: int) -> tuple[tuple, int]:
    """The piece after one more byte, and the net tokens this adds."""
    node, before, _ = piece
    after = bpe.step(node, byte)
    past = {n: (last, count) for n, last, count in before}
    own = fin = None
    s = after
    while s:
        n = bpe.depth[s]
        if n - 1 in past:
            last, count = past[n - 1]
            t = bpe.inner[s]
            if own is None and t is not None and (last is None or bpe.gets_on(last, t)):
                own = t, count + 1
            t = bpe.final[s]
            if fin is None and t is not None and (last is None or bpe.gets_on(last, t)):
                fin = count + 1
            if own is not None and fin is not None:
                break
        s = bpe.fail[s]
    token, total = own
    live, s = [], after
    while s:
        n = bpe.depth[s]
        if n - 1 in past:
            last, count = past[n - 1]
            live.append((n, last, count - total))
        s = bpe.fail[s]
    live.append((0, token, 0))
    return (after, tuple(live), fin - total), total


class Transducer:
    """The lazily compiled machine. States: idle (0), an apostrophe and its continuations, and pieces in progress."""

    IDLE = ("idle",)

    def __init__(self, bpe: Bpe, room: int = ROOM, alphabet: int = ALPHABET):
        self.bpe, self.room, self.alphabet = bpe, room, alphabet
        self.column = np.full(sys.maxunicode + 1, alphabet, np.int32)  # the last column: characters without one
        self.columns = 0
        self.kinds: dict[str, int] = {}
        self.column_char: list[str] = []
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.id_of: dict[tuple, int] = {}
        self.rows = 1024
        self.next = np.full((self.rows, self.alphabet + 1), -1, np.int32)
        self.emit = np.zeros((self.rows, self.alphabet + 1), np.int16)
        self.finish = np.zeros(self.rows, np.int16)
        self.rare: dict[tuple[int, str], tuple[int, int]] = {}
        self.state(self.IDLE)

    def state(self, s: tuple) -> int:
        i = self.id_of.get(s)
        if i is None:
            i = self.id_of[s] = len(self.states)
            self.states.append(s)
            if i >= self.rows:
                self.rows += max(1024, self.rows // 4)
                for name, fill in (("next", -1), ("emit", 0), ("finish", 0)):
                    old = getattr(self, name)
                    new = np.full((self.rows, *old.shape[1:]), fill, old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)
            self.finish[i] = self._pending(s)
        return i

    def kind(self, c: str) -> int:
        k = self.kinds.get(c)
        if k is None:
            cat = unicodedata.category(c)
            k = self.kinds[c] = SPACE if c in WHITE else LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else OTHER
        return k

    def _piece(self, text: str) -> tuple[tuple, int]:
        p, n = START, 0
        for b in text.encode("utf-8", "surrogatepass"):
            p, k = advance(self.bpe, p, b)
            n += k
        return p, n

    def _count(self, text: str) -> int:
        p, n = self._piece(text)
        return n + p[2]

    def _pending(self, s: tuple) -> int:
        """Tokens still to come if the text ends in this state."""
        if s[0] == "piece":
            return s[2][2]
        if s[0] == "apostrophe":
            return self._count("'") + (self._count(s[1]) if s[1] else 0)
        return 0

    def _from_idle(self, c: str) -> tuple[tuple, int]:
        k = self.kind(c)
        if k == SPACE:
            return self.IDLE, 0
        if k == NUMBER:
            return self.IDLE, self._count(c)
        if c == "'":
            return ("apostrophe", ""), 0
        p, n = self._piece(c)
        return ("piece", k, p), n

    def _move(self, s: tuple, c: str) -> tuple[tuple, int]:
        if s[0] == "idle":
            return self._from_idle(c)
        if s[0] == "apostrophe":
            tail = "'" + s[1] + c
            if tail in CONTRACTIONS:
                return self.IDLE, self._count(tail)
            if any(x.startswith(tail) for x in CONTRACTIONS):
                return ("apostrophe", s[1] + c), 0
            if s[1]:  # the apostrophe was a piece, and a letter run began
                p, n = self._piece(s[1])
                t, m = self._move(("piece", LETTER, p), c)
                return t, self._count("'") + n + m
            p, n = self._piece("'")
            t, m = self._move(("piece", OTHER, p), c)
            return t, n + m
        _, k, p = s
        if self.kind(c) == k:
            n = 0
            for b in c.encode("utf-8", "surrogatepass"):
                p, m = advance(self.bpe, p, b)
                n += m
            return ("piece", k, p), n
        t, n = self._from_idle(c)
        return t, p[2] + n

    def compile(self, s: int, c: str) -> tuple[int, int]:
        """The transition from state s on character c, kept in the table or, for rare characters, beside it."""
        j = int(self.column[ord(c)])
        if j == self.alphabet and self.columns < self.alphabet:
            j = self.column[ord(c)] = self.columns
            self.columns += 1
            self.column_char.append(c)
        if j == self.alphabet:
            known = self.rare.get((s, c))
            if known is None:
                t, n = self._move(self.states[s], c)
                known = self.rare[s, c] = self.state(t), n
            return known
        if self.next[s, j] < 0:
            t, n = self._move(self.states[s], c)
            i = self.state(t)
            self.next[s, j], self.emit[s, j] = i, n
        return int(self.next[s, j]), int(self.emit[s, j])

    def run(self, text: str, s: int = 0) -> tuple[int, int]:
        """Exit state and tokens emitted, one character after another."""
        n = 0
        for c in text:
            s, k = self.compile(s, c)
            n += k
        return s, n

    def lanes(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run points[begin:end] of each lane from state s: exit states and tokens, all lanes in step."""
        order = np.argsort(begin - end, kind="stable")  # longest first
        at, size, s = begin[order].copy(), (end - begin)[order], s[order].astype(np.int32)
        n = np.zeros(len(s), np.int64)
        cols = self.column[points]
        steps = int(size[0]) if len(size) else 0
        live_at = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes longer than each step
        for i in range(steps):
            m = live_at[i]
            j, here = cols[at[:m] + i], s[:m]
            t = self.next[here, j]
            k = self.emit[here, j]
            miss = np.flatnonzero(t < 0) if (t < 0).any() else ()
            for x in miss:
                t[x], k[x] = self.compile(int(here[x]), chr(points[at[x] + i]))
            if len(miss):
                cols = self.column[points] if self._new_columns() else cols
            s[:m] = t
            n[:m] += k
        out_s, out_n = np.empty_like(s), np.empty_like(n)
        out_s[order], out_n[order] = s, n
        return out_s, out_n

    def _new_columns(self) -> bool:
        grown, self._seen = self.columns != getattr(self, "_seen", 0), self.columns
        return grown


class ChunkMap:
    """What a chunk does to any entry state: run `head` from it; if the chunk has a white space, then n tokens and exit."""

    def __init__(self, head: str, n: int | None = None, exit: int = 0):
        self.head, self.n, self.exit = head, n, exit

    def after(self, first: ChunkMap, machine: Transducer) -> ChunkMap:
        """The map of `first` followed by this one. Associative."""
        if first.n is None:
            return ChunkMap(first.head + self.head, self.n, self.exit)
        s, k = machine.run(self.head, first.exit)
        if self.n is None:
            return ChunkMap(first.head, first.n + k, s)
        return ChunkMap(first.head, first.n + k + self.n, self.exit)

    def apply(self, machine: Transducer, s: int = 0) -> tuple[int, int]:
        s, k = machine.run(self.head, s)
        return (s, k) if self.n is None else (self.exit, k + self.n)


def normalise(text: str) -> str:
    """NFC, then lower case character by character."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, room: int = ROOM, alphabet: int = ALPHABET):
        self.machine = Transducer(Bpe(path), room, alphabet)
        self.special = re.compile("|".join(map(re.escape, self.machine.bpe.special))) if self.machine.bpe.special else None
        self.chunk = chunk
        self.white = np.zeros(sys.maxunicode + 1, bool)
        self.white[[ord(c) for c in WHITE]] = True

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        machine = self.machine
        if len(machine.states) > machine.room or len(machine.rare) > machine.room:
            machine.reset()
            machine.bpe.agree.clear()
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.special is not None and self.special.search(t):
                pieces = self.special.split(t)
                total[i] += len(pieces) - 1
            else:
                pieces = [t]
            for p in pieces:
                if p:
                    parts.append(normalise(p))
                    owner.append(i)
        if not parts:
            return total.tolist()
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        begins = np.concatenate([[0], ends[:-1]])
        # Chunks of all parts, and where the first white space of each is.
        n_chunks = -(-(ends - begins) // self.chunk)
        part = np.repeat(np.arange(len(parts)), n_chunks)
        nth = np.arange(len(part)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        b = begins[part] + nth * self.chunk
        e = np.minimum(b + self.chunk, ends[part])
        blank = np.flatnonzero(self.white[points])
        at = np.searchsorted(blank, b)
        sync = np.where(at < len(blank), np.append(blank, len(points))[np.minimum(at, len(blank))], len(points)) if len(blank) else np.full(len(b), len(points))
        sync = np.where(nth == 0, b, np.minimum(sync, e))  # a part's first chunk begins idle
        has = (nth == 0) | (sync < e)
        exits, n = machine.lanes(points, sync, e, np.zeros(len(b), np.int32))
        # Prefix scan. A chunk's entry state is the exit of the one before; where that one has no white space, maps compose.
        easy = has & (nth > 0) & np.concatenate([[False], has[:-1]])
        head = np.flatnonzero(easy)
        if len(head):
            s, k = machine.lanes(points, b[head], sync[head], exits[head - 1])
            # The white space emits what was pending, which the lane from `sync` on, begun idle, hasn't.
            n[head] += k + machine.finish[s]
        hard = np.flatnonzero(~easy & (nth > 0))
        for x in hard:
            y = x - 1
            prior = ChunkMap("", 0, int(exits[y]))
            text = points[b[x] : sync[x]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            if has[x]:
                s, k = machine.run(text, prior.exit)
                n[x] += k + machine.finish[s]
            else:
                joined = ChunkMap(text).after(prior, machine)
                exits[x], n[x] = joined.exit, joined.n
        np.add.at(total, np.asarray(owner)[part], n)
        last = np.cumsum(n_chunks) - 1
        np.add.at(total, np.asarray(owner), machine.finish[exits[last]].astype(np.int64))
        return total.tolist()


@lru_cache(1)
def counter(path: str) -> Counter:
    """One machine per process: what one task compiled serves the next."""
    return Counter(path)


forgettable(__name__, lambda: counter.cache_info().currsize, counter.cache_clear)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""

    @lean
    def run(batches):
        c = counter(tokenizer_path)
        for b in sliced(batches, 1):
            texts = b.column(1).to_pylist()
            n: list[int] = []
            for s, e in chunks([len(t or "") for t in texts], AT_ONCE):
                n += c.counts(texts[s:e])
            size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
