"""Static range asymmetric numeral system over interleaved blocks, on NumPy arrays.

A shared table gives each symbol a frequency of 2^SCALE. Each block of tokens is coded by LANES interleaved coders that
share one stream of 32-bit words; blocks don't depend on each other. The states at every checkpoint and the number of
words before it are kept, so decoding can begin there, and every block has a CRC-32 of its tokens and of its words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE, LANES, STEPS, EVERY = 18, 64, 512, 256
LOW = np.uint64(1 << 31)
MAGIC, VERSION = b"RNSB", 1
_HEAD = struct.Struct("<4sHBBHHQQQII")


class CorruptBlock(ValueError):
    """A checksum of a block doesn't hold."""


@dataclass
class Table:
    """Frequencies that sum to 2^SCALE; a symbol without one can't be coded."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = np.asarray(self.freq, np.uint32)
        if int(self.freq.sum(dtype=np.uint64)) != 1 << SCALE:
            raise ValueError("frequencies don't sum to the scale")
        self.f = self.freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        # One look-up a step: symbol, frequency and start share a number, by symbol and by slot.
        symbol = np.arange(len(self.freq), dtype=np.uint64)
        self.both = self.f << np.uint64(20) | self.start
        slots = np.repeat(symbol << np.uint64(40) | self.f << np.uint64(20), self.freq)
        self.slot = slots | (np.arange(1 << SCALE, dtype=np.uint64) - np.repeat(self.start, self.freq))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Counts scaled so that each symbol that occurs keeps a slot; the rest goes to the symbols it costs least."""
        counts = np.asarray(counts, np.float64)
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (1 << SCALE) / max(counts.sum(), 1))), 0).astype(np.int64)
        if not freq.any():
            freq[0] = 1
        if (freq > 0).sum() > 1 << SCALE:
            raise ValueError("more symbols than slots")
        left = (1 << SCALE) - int(freq.sum())
        order = np.argsort(-counts, kind="stable")
        if left > 0:
            freq[order[0]] += left
        while left < 0:
            over = order[freq[order] > 1]
            take = np.minimum(freq[over] - 1, np.maximum(1, freq[over] * -left // max(1, int(freq[over].sum()))))
            cut = np.minimum(np.cumsum(take), -left)
            freq[over] -= np.diff(np.concatenate([[0], cut]))
            left = (1 << SCALE) - int(freq.sum())
        return cls(freq)


def _encode(ids: np.ndarray, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (blocks, steps, LANES) -> words and their mask (blocks, steps, LANES), states (blocks, checkpoints, LANES)."""
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words = np.empty(ids.shape, np.uint32)
    out = np.empty(ids.shape, bool)
    states = np.empty((blocks, -(-steps // EVERY), lanes), np.uint64)
    k, most, w, low = np.uint64(SCALE), np.uint64(63 - SCALE), np.uint64(32), np.uint64((1 << 20) - 1)
    for i in range(steps - 1, -1, -1):
        both = t.both[ids[:, i]]
        f = both >> np.uint64(20)
        full = x >= f << most
        words[:, i] = x.astype(np.uint32)
        out[:, i] = full
        x = np.where(full, x >> w, x)
        q = x // f
        x = (q << k) + (x - q * f) + (both & low)
        if i % EVERY == 0:
            states[:, i // EVERY] = x
    return words, out, states


def _decode(x: np.ndarray, words: np.ndarray, pos: np.ndarray, steps: int, t: Table) -> tuple[np.ndarray, np.ndarray]:
    """States (blocks, LANES) and first word of each block -> ids (blocks, steps, LANES) and the words' end."""
    ids = np.empty((len(x), steps, x.shape[1]), np.uint32)
    k, w, mask, low = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1), np.uint64((1 << 20) - 1)
    for i in range(steps):
        v = t.slot[x & mask]
        ids[:, i] = v >> np.uint64(40)
        x = (v >> np.uint64(20) & low) * (x >> k) + (v & low)
        need = x < LOW
        nth = np.cumsum(need, axis=1)
        at = (pos[:, None] + nth - 1)[need]
        x[need] = x[need] << w | words[at].astype(np.uint64)
        pos = pos + nth[:, -1]
    return ids, pos


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lens: np.ndarray, start: int, table: Table) -> bytes:
    """The bytes of a segment: header, document table, block directory, then blocks of states and words."""
    n, size = len(ids), STEPS * LANES
    parts, directory = [], []
    ids = np.asarray(ids, np.uint32)
    full = n // size
    groups = [ids[: full * size].reshape(full, STEPS, LANES)] if full else []
    if tail := n - full * size:
        steps = -(-tail // LANES)
        last = np.full(steps * LANES, int(np.argmax(table.freq)), np.uint32)
        last[:tail] = ids[full * size :]
        groups.append(last.reshape(1, steps, LANES))
    at = 0
    for g in groups:
        words, out, states = _encode(g, table)
        for b in range(len(g)):
            w = words[b][out[b]].astype("<u4").tobytes()
            before = np.concatenate([[0], np.cumsum(out[b].sum(axis=1))])[: g.shape[1] : EVERY]
            body = before.astype("<u4").tobytes() + states[b].astype("<u8").tobytes() + w
            m = min(size, n - at)
            directory.append((m, len(w) // 4, zlib.crc32(ids[at : at + m].astype("<u4").tobytes()), zlib.crc32(body)))
            parts.append(body)
            at += m
    nulls = np.array([k is None for k in doc_ids], np.uint8)
    keys = np.array([k or 0 for k in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, VERSION, SCALE, LANES, STEPS, EVERY, start, n, len(doc_ids), len(directory), table.crc)
    docs = keys.tobytes() + nulls.tobytes() + np.asarray(lens, "<u8").tobytes()
    rest = np.array(directory, "<u4").reshape(-1, 4).tobytes()
    return b"".join([head, docs, rest, struct.pack("<I", zlib.crc32(head + docs + rest)), *parts])


@dataclass
class Segment:
    """A parsed segment; blocks are decoded on demand."""

    start: int
    n_tokens: int
    doc_ids: list
    lens: np.ndarray
    directory: np.ndarray
    bodies: list[memoryview]
    table: Table

    def block(self, b: int, checkpoint: int = 0) -> np.ndarray:
        """Ids of block b from a checkpoint on (0: all of it, with its checksums verified)."""
        return self._run([b], checkpoint)[0]

    def _run(self, which: list[int], checkpoint: int = 0) -> list[np.ndarray]:
        m = int(self.directory[which[0], 0])
        steps = -(-m // LANES)
        marks = -(-steps // EVERY)
        states = np.empty((len(which), LANES), np.uint64)
        words, pos, at = [], [], 0
        for k, b in enumerate(which):
            body = self.bodies[b]
            if zlib.crc32(body) != self.directory[b, 3]:
                raise CorruptBlock(f"block {b}: words")
            before = np.frombuffer(body, "<u4", marks)
            states[k] = np.frombuffer(body, "<u8", LANES, 4 * marks + 8 * LANES * checkpoint)
            words.append(np.frombuffer(body, "<u4", -1, 4 * marks + 8 * LANES * marks))
            pos.append(at + int(before[checkpoint]))
            at += len(words[-1])
        flat = np.concatenate(words) if words else np.empty(0, np.uint32)
        ids, _ = _decode(states, flat, np.array(pos, np.int64), steps - checkpoint * EVERY, self.table)
        out = [x.reshape(-1)[: m - checkpoint * EVERY * LANES] for x in ids]
        if not checkpoint:
            for b, x in zip(which, out):
                if zlib.crc32(x.astype("<u4").tobytes()) != self.directory[b, 2]:
                    raise CorruptBlock(f"block {b}: tokens")
        return out

    def ids(self, at_once: int = 64) -> np.ndarray:
        """All ids of the segment, blocks of one size in step with each other."""
        out, n = [], len(self.directory)
        full = int((self.directory[:, 0] == STEPS * LANES).sum())
        for a in range(0, full, at_once):
            out += self._run(list(range(a, min(full, a + at_once))))
        for b in range(full, n):
            out += self._run([b])
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def open_segment(data: bytes, table: Table) -> Segment:
    magic, version, scale, lanes, steps, every, start, n, n_docs, n_blocks, crc = _HEAD.unpack_from(data)
    if (magic, version, scale, lanes, steps, every) != (MAGIC, VERSION, SCALE, LANES, STEPS, EVERY):
        raise ValueError("not a segment of this format")
    if crc != table.crc:
        raise ValueError("the segment was coded with another table")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lens = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    directory = np.frombuffer(data, "<u4", 4 * n_blocks, at).reshape(-1, 4)
    at += 16 * n_blocks
    if struct.unpack_from("<I", data, at)[0] != zlib.crc32(data[:at]):
        raise CorruptBlock("header")
    at += 4
    bodies, view = [], memoryview(data)
    for m, w, _, _ in directory.tolist():
        marks = -(-(-(-m // LANES)) // EVERY)
        size = 4 * marks + 8 * LANES * marks + 4 * w
        bodies.append(view[at : at + size])
        at += size
    return Segment(start, n, [None if x else k for k, x in zip(keys.tolist(), nulls)], lens, directory, bodies, table)
