"""64-bit hashes of the words of many texts at once, on NumPy arrays.

A word is a maximal run of bytes other than space and 9 to 13. A to Z are lower-cased; other bytes stay. Each byte
value has a random 64-bit number; a word's hash is a polynomial in them modulo 2^64, taken from running sums, then mixed.
"""

from __future__ import annotations

import numpy as np

from .common import chunks, forgettable

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
AT_ONCE = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def _forget() -> None:
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


forgettable(__name__, lambda: len(_powers[0]) > 1, _forget)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hash_block(data: np.ndarray) -> np.ndarray:
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    s, e = edge[::2], edge[1::2]
    p, q = _power_tables(len(data) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * p[: len(data)], dtype=np.uint64)])
    return mix((run[e] - run[s]) * q[s] + (e - s).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one byte string, block by block; blocks end at white space."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= 2 * AT_ONCE:
        return _hash_block(a)
    out, at = [], 0
    while at < len(a):
        end = min(len(a), at + AT_ONCE)
        while end < len(a):
            gap = np.flatnonzero(_BLANK[a[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(a), end + 4096)
        out.append(_hash_block(a[at:end]))
        at = end
    return np.concatenate(out)


def many(texts: list[str | None]):
    """Yield (start, stop, hashes, bounds): words of texts[start:stop], bounds[i]:bounds[i + 1] those of the i-th."""
    return many_bytes([(t or "").encode("utf-8", "surrogatepass") for t in texts])


def many_bytes(raw: list[bytes]):
    """The same of byte strings."""
    for s, e in chunks([len(r) for r in raw], AT_ONCE):
        if e - s == 1:
            h = word_hashes(raw[s])
            yield s, e, h, np.array([0, len(h)])
            continue
        block = b"\n".join(raw[s:e])
        data = np.frombuffer(block, np.uint8)
        h = _hash_block(data)
        blank = np.concatenate([[True], _BLANK[data]])
        first = np.flatnonzero(blank[:-1] & ~blank[1:])
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw[s:e]])])
        yield s, e, h, np.searchsorted(first, begins)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; of fewer words, one of them all; of none, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * _STEP + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h + np.uint64(n)))
