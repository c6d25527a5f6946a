"""Secret scans with inferred grammars (operator 6).

Method: labelled credentials train one probabilistic automaton per format. A prefix tree of the examples is built and
its states are merged in breadth-first order where their outgoing and stopping frequencies agree statistically
(ALERGIA with the Hoeffding bound). Every candidate run of the text is then scored by its best log-likelihood under
the automata less that under a Markov model of ordinary runs; candidates above the threshold become
spans, and every candidate is reported with its likeliest format and score. Within a run a candidate starts at its begin, after any punctuation or at the literal of a format, and ends at its
end or before any punctuation: KEY=value, paths and URLs are such runs. Three fixed patterns (assignments, access keys, hex
runs) always add their spans beside these.

The labelled credentials are EXAMPLES_PER_FORMAT seeded draws of each of the public formats in FORMATS: a bounded set,
independent of the corpus. Ordinary runs are ORDINARY seeded draws and, weighing at most as much, the runs without a find of all
documents; of these only counts of class pairs are gathered, so what reaches the driver is bounded at any size.

Edge cases: null and empty texts have no span; offsets are code points, end exclusive; repeated rows give equal
results each; an empty table gives no rows; texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-]")
PUNCTUATION = re.compile(r"[+/_.=-]")
#: Least characters of a candidate, as CANDIDATE has it.
SHORTEST = 16
KINDS = ("assign", "access", "hex", "format")

# Public credential formats: literal parts and (alphabet, length) parts.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM, URL64 = UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "-_"
FORMATS: dict[str, tuple] = {
    "aws_access": ("AKIA", (UPPER + "234567", 16)),
    "github": ("ghp_", (ALNUM, 36)),
    "gitlab": ("glpat-", (URL64, 20)),
    "npm": ("npm_", (ALNUM, 36)),
    "google": ("AIza", (URL64, 35)),
    "slack": ("xoxb-", (DIGITS, 12), "-", (DIGITS, 12), "-", (ALNUM, 24)),
    "stripe": ("sk_live_", (ALNUM, 24)),
    "sendgrid": ("SG.", (URL64, 22), ".", (URL64, 43)),
    "jwt": ("eyJ", (ALNUM, 33), ".eyJ", (ALNUM, 57), ".", (URL64, 43)),
    "base64_40": ((ALNUM + "+/", 40),),
    "hex_32": (("0123456789abcdef", 32),),
    "hex_40": (("0123456789abcdef", 40),),
}
EXAMPLES_PER_FORMAT, ALPHA, MIN_COUNT = 150, 0.05, 8
#: Ordinary runs drawn from a seed; the runs of the documents are counted beside them.
ORDINARY = 4000
#: Least log-likelihood ratio for each character of a candidate.
THRESHOLD = 0.55
#: Log-probability of a class that a state of an automaton never saw in training.
UNSEEN = math.log(0.002)


def labelled_credentials(per_format: int = EXAMPLES_PER_FORMAT, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) training rows."""
    rng = random.Random(seed)
    draw = lambda part: part if isinstance(part, str) else "".join(rng.choices(part[0], k=part[1]))
    return [(name, "".join(map(draw, parts))) for name, parts in FORMATS.items() for _ in range(per_format)]


def symbols(value: str) -> str:
    """Classes of characters: f for a-f, l for other lower case, U upper case, d digits; punctuation as it is."""
    return value.translate(_CLASSES)


_CLASSES = str.maketrans({**dict.fromkeys("abcdef", "f"), **dict.fromkeys(LOWER[6:], "l"), **dict.fromkeys(UPPER, "U"), **dict.fromkeys(DIGITS, "d")})
#: Log of the characters in each class, to turn class likelihoods into character likelihoods.
_SPREAD = {"f": math.log(6), "l": math.log(20), "U": math.log(26), "d": math.log(10)}


class Automaton:
    """A probabilistic automaton over character classes, learned by state merging."""

    def __init__(self, words: Iterable[str], alpha: float = ALPHA, min_count: int = MIN_COUNT):
        words = list(words)
        self.literal = self._common_prefix(words)
        words = [symbols(w[len(self.literal):]) for w in words]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.stop = [0]
        for w in words:
            s = 0
            for c in w:
                self.count[s][c] += 1
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.stop.append(0)
                s = self.next[s][c]
            self.stop[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.min_count = min_count
        self._merge_all()
        self._freeze()
        self.alphabet = {c for s in self.count for c in s}

    @staticmethod
    def _common_prefix(words: list[str]) -> str:
        a, b = min(words), max(words)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return a[:n]

    def total(self, s: int) -> int:
        return self.stop[s] + sum(self.count[s].values())

    def _differ(self, x: int, nx: int, y: int, ny: int) -> bool:
        return abs(x / nx - y / ny) > self.bound * (nx**-0.5 + ny**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total(a), self.total(b)
            if min(na, nb) < self.min_count:  # too few examples to tell them apart
                continue
            if self._differ(self.stop[a], na, self.stop[b], nb):
                return False
            for c in {*self.count[a], *self.count[b]}:
                if self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stop[a] += self.stop[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_all(self) -> None:
        """Red states stay; each blue state, a child of a red one, merges into the first compatible red state or turns red."""
        red = [0]
        while True:
            # The heaviest blue state comes first; folding may have given any red state new children.
            blue = max(((self.total(t), -r, c) for r in red for c, t in self.next[r].items() if t not in red), default=None)
            if blue is None:
                return
            p, c = -blue[1], blue[2]
            b = self.next[p][c]
            for r in red:
                if self._compatible(r, b):
                    self.next[p][c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)

    def _freeze(self) -> None:
        self.logp: list[dict[str, float]] = []
        self.logstop: list[float] = []
        for s in range(len(self.next)):
            n = self.total(s) + 1e-9
            self.logp.append({c: math.log(k / n) for c, k in self.count[s].items()})
            self.logstop.append(math.log(max(self.stop[s], 1e-6) / n))

    def score(self, value: str) -> float:
        """Log-likelihood of a value (-inf without the literal part). A class that a state never saw costs UNSEEN."""
        if not value.startswith(self.literal):
            return -math.inf
        s, total = 0, 0.0
        for c in symbols(value[len(self.literal):]):
            p = self.logp[s].get(c)
            total += (UNSEEN if p is None else p) - _SPREAD.get(c, 0.0)
            s = self.next[s].get(c, s)
        return total + self.logstop[s]


def train(examples: Iterable[tuple[str, str]] | None = None) -> dict[str, Automaton]:
    """One automaton for each labelled format."""
    by: dict[str, list[str]] = defaultdict(list)
    for name, value in examples or labelled_credentials():
        by[name].append(value)
    return {name: Automaton(values) for name, values in sorted(by.items())}


def ordinary_runs(n: int = ORDINARY, seed: int = 9) -> list[str]:
    """Seeded runs that are no secrets: words and identifiers, paths, hosts, dates, numbers, rules and file names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aaeeeiioou") + rng.choice(("", "", "n", "r", "s", "t", "l")) for _ in range(rng.randint(1, 4)))
    digits = lambda k: "".join(rng.choices(DIGITS, k=k))
    words = lambda lo=2, hi=5: [word() for _ in range(rng.randint(lo, hi))]
    kinds = (
        lambda: "".join(words(3, 6)),
        lambda: "_".join(words()),
        lambda: "-".join(words()),
        lambda: "".join(w.capitalize() for w in words(2, 5)),
        lambda: "_".join(words()).upper(),
        lambda: "/" + "/".join(words(2, 6)),
        lambda: ".".join([word() + rng.choice(("", digits(1))), word(), rng.choice(("com", "org", "net"))]),
        lambda: f"{word()}={word()}{rng.choice(('', digits(2)))}",
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(2)}.{digits(2)}",
        lambda: digits(rng.randint(16, 24)),
        lambda: rng.choice("-=_./+") * rng.randint(16, 60),
        lambda: f"{word().upper()}_20{digits(6)}_{digits(6)}-{digits(4)}.jpg",
        lambda: f"{'_'.join(words(1, 3))}.{word()}-{digits(1)}.{digits(2)}.{digits(1)}.tar",
    )
    return [rng.choice(kinds)() for _ in range(n)]


class Background:
    """The model of ordinary runs: how classes of characters follow each other, counted."""

    SAID = "flUd+/_.=-"

    def __init__(self, runs: Iterable[str] = (), counts: dict[tuple[str, str], float] | None = None):
        """runs, and counts of (class before or "", class) from elsewhere, which weigh at most as much as the runs together."""
        own: dict[tuple[str, str], float] = defaultdict(float)
        for r in runs:
            for pair in pairs(symbols(r)):
                own[pair] += 1
        scale = min(1.0, (sum(own.values()) or 1.0) / max(1.0, sum(counts.values()))) if counts else 0.0
        for pair, n in (counts or {}).items():
            own[pair] += n * scale
        self.log: dict[tuple[str, str], float] = {}
        for last in ("", *self.SAID):
            total = sum(own.get((last, c), 0.0) + 1 for c in self.SAID)
            for c in self.SAID:
                self.log[last, c] = math.log((own.get((last, c), 0.0) + 1) / total) - _SPREAD.get(c, 0.0)

    def step(self, last: str, c: str) -> float:
        """Log-likelihood of a character of class c behind one of class last; a character of no class counts nothing."""
        return self.log.get((last, c), 0.0)

    def __call__(self, value: str) -> float:
        """Log-likelihood of a run."""
        return sum(self.step(*pair) for pair in pairs(symbols(value)))


def pairs(said: str):
    """(class before or "", class) of each character."""
    return zip(("", *said), said)


def ordinary_counts(docs: DataFrame, automata: dict[str, Automaton], text: str = "text") -> dict[tuple[str, str], float]:
    """Class pairs of the long runs of all documents.

    Runs in base spans, and those in which the automata find something against the seeded runs alone, are left out. At
    most one number for each pair of classes reaches the driver.
    """
    scanner_of = _scanner_factory(automata, Background(ordinary_runs()))
    texts = docs.select(docs[text].cast("string").alias("text")).filter("text is not null")

    @lean
    def run(batches):
        found: dict[tuple[str, str], int] = defaultdict(int)
        scanner = scanner_of()
        for b in sliced(batches, 0):
            for t in b.column(0).to_pylist():
                base = base_spans(t)
                for m in CANDIDATE.finditer(t):
                    if not any(s < m.end() and m.start() < e for s, _, e in base) and not scanner.parts(m[0]):
                        for pair in pairs(symbols(m[0])):
                            found[pair] += 1
        names = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string()), pa.array([found[x] for x in names], pa.int64())], ["last", "c", "n"])

    rows = texts.mapInArrow(run, "last string, c string, n long").groupBy("last", "c").agg(F.sum("n").alias("n")).collect()
    return {(r["last"], r["c"]): float(r["n"]) for r in rows}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Scanner:
    def __init__(self, automata: dict[str, Automaton], threshold: float = THRESHOLD, background: Background | None = None):
        self.automata, self.threshold = automata, threshold
        self.background = background or Background(ordinary_runs())
        self._kept = lru_cache(65536)(self._parts)

    def score(self, value: str) -> tuple[str | None, float]:
        """The likeliest format of a value and the log-likelihood ratio of a character; none where no literal stands."""
        best = max(((a.score(value), name) for name, a in self.automata.items()), default=(-math.inf, ""))
        if best[0] == -math.inf or not value:
            return None, -math.inf
        return best[1], (best[0] - self.background(value)) / len(value)

    def judge(self, value: str) -> tuple[str, float] | None:
        name, ratio = self.score(value)
        return (name, ratio) if ratio >= self.threshold else None

    def parts(self, run: str) -> list[tuple[int, int, str, float]]:
        """As _parts; answers of short runs are kept."""
        return self._kept(run) if len(run) <= 200 else self._parts(run)

    def _parts(self, run: str) -> list[tuple[int, int, str, float]]:
        """(start, end, format, score) of the candidates in a run that pass and don't overlap, in order.

        A candidate passes if its log-likelihood ratio less threshold * length is 0 or more. That sum grows character by
        character, so each state of an automaton keeps its best starts only: one pass over a run of any length. No
        candidate crosses punctuation that its format never has, but for the run as a whole. A start or end
        at punctuation that the format does have may be within a credential, so such a candidate ranks below whole ones, and
        one without a literal below one with.
        """
        whole = self.judge(run)
        cuts = {m.start() for m in PUNCTUATION.finditer(run)}
        if not cuts and not any(a.literal and a.literal in run for a in self.automata.values()):
            return [(0, len(run), *whole)] if whole else []
        said, n_run, step = symbols(run), len(run), self.background.step
        passed = []
        for name, a in self.automata.items():
            n = len(a.literal)
            if n:  # by the place where the literal ends and the automaton begins
                starts = {m.start() + n: m.start() for m in re.finditer(f"(?={re.escape(a.literal)})", run)}
            else:
                starts = {i: i for i in {0} | {c + 1 for c in cuts}}
            live: dict[tuple[int, bool], tuple[float, int]] = {}  # by state, and whether the start is within
            for i in range(n_run + 1):
                if live and (i == n_run or i in cuts):
                    within = i < n_run and said[i] in a.alphabet
                    for inner in (False, True):
                        best = max(((x + a.logstop[s], -at) for (s, k), (x, at) in live.items() if k == inner), default=(-1.0, 0))
                        if best[0] >= 0 and i + best[1] >= SHORTEST:
                            passed.append((inner + within, -best[1], i, name, best[0]))
                if i == n_run:
                    break
                c = said[i]
                if i in cuts and c not in a.alphabet:
                    live = {}
                elif live or i in starts:
                    less = step(said[i - 1] if i else "", c) + self.threshold
                    moves = [(s, k, x, at, less) for (s, k), (x, at) in live.items()]
                    if i in starts:  # what comes before a candidate doesn't count for its first character
                        at = starts[i]
                        x = -self.background(run[at:i]) - self.threshold * n
                        within = bool(live) if n else i > 0 and said[i - 1] in a.alphabet
                        moves.append((0, within, x, at, less if n else step("", c) + self.threshold))
                    live = {}
                    for s, k, x, at, less in moves:
                        p, to = a.logp[s].get(c), (a.next[s].get(c, s), k)
                        x += (UNSEEN if p is None else p) - _SPREAD.get(c, 0.0) - less
                        if to not in live or live[to][0] < x:
                            live[to] = (x, at)
        taken: list[tuple] = []
        for y in sorted(passed, key=lambda y: (y[0], not self.automata[y[3]].literal, -y[4], y[1], y[3])):
            if not any(y[1] < z[2] and z[1] < y[2] for z in taken):
                taken.append(y)
        named = any(self.automata[y[3]].literal for y in taken)
        if whole and not named and (whole[1] - self.threshold) * n_run > sum(y[4] for y in taken):
            return [(0, n_run, *whole)]
        return sorted((s, e, f, x / (e - s) + self.threshold) for _, s, e, f, x in taken)

    base = staticmethod(base_spans)

    def scan(self, text: str | None) -> tuple[list, list]:
        """Base spans, and the spans that the automata add: (start, kind index, end, format, score)."""
        base, more, _ = self.scored(text)
        return base, more

    def scored(self, text: str | None) -> tuple[list, list, list]:
        """Base spans, added spans, and every candidate with its likeliest format and score: (start, kind index, end, format, score).

        Candidates are the values of base spans, the runs as wholes (kind index 4) and the added spans.
        """
        if not text:
            return [], [], []
        base, more, all_ = self.base(text), [], []
        for s, k, e in base:
            value = ASSIGN.match(text, s)[2] if k == 0 else text[s:e]
            all_.append((s, k, e, *self.score(value)))
        for m in CANDIDATE.finditer(text):
            if not any(s <= m.start() and m.end() <= e for s, _, e in base):
                all_.append((m.start(), len(KINDS), m.end(), *self.score(m[0])))
            for a, z, *found in self.parts(m[0]):
                a, z = m.start() + a, m.start() + z
                if not any(s <= a and z <= e for s, _, e in base):
                    more.append((a, 3, z, *found))
        return base, more, sorted([*all_, *more], key=lambda x: x[:3])


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, kind, start, end, value, format, score): one row per span."""
    automata = train()
    scanner_of = _scanner_factory(automata, Background(ordinary_runs(), ordinary_counts(docs, automata, text)))

    @lean
    def run(batches):
        scanner = scanner_of()
        for b in sliced(batches, 1):
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, more = scanner.scan(t)
                rows += [(k, KINDS[i], s, e, t[s:e], None, None) for s, i, e in base]
                rows += [(k, KINDS[i], s, e, t[s:e], f, x) for s, i, e, f, x in more]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, kinds)], ["doc_id", "kind", "start", "end", "value", "format", "score"])

    return docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(
        run, "doc_id long, kind string, start long, end long, value string, format string, score double"
    )


def _scanner_factory(automata: dict[str, Automaton], background: Background):
    held: list[Scanner] = []

    def get() -> Scanner:
        if not held:
            held.append(Scanner(automata, background=background))
        return held[0]

    return get


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, n_candidates long, scores string"


def scan_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document, the columns of DIGEST.

    scores: kind:start:end:format:ratio of every candidate, comma-joined; kind `run` is a run as a whole, format `-` and ratio
    `-inf` mean that no automaton can say it. Ratios are log-likelihood ratios a character against ordinary runs.
    """
    automata = train()
    scanner_of = _scanner_factory(automata, Background(ordinary_runs(), ordinary_counts(docs, automata, text)))

    @lean
    def run(batches):
        scanner = scanner_of()
        for b in sliced(batches, 1):
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, more, all_ = scanner.scored(t)
                n = [sum(i == x for _, i, _ in base) for x in range(3)]
                said = lambda spans: ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in spans)
                scores = ",".join(f"{(*KINDS, 'run')[i]}:{s}:{e}:{f or '-'}:{x:.3f}" for s, i, e, f, x in all_)
                rows.append((k, *n, hashlib.sha256(said(base).encode()).hexdigest(), said(sorted([*base, *(x[:3] for x in more)])), len(more), len(all_), scores))
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, DIGEST)
