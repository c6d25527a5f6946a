"""Sequence models: padding, augmentation, a gated recurrent encoder with attention pooling, and its contrastive training."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pad(c, length: int):
    """An array column cut or filled with zeros to a length, and its mask."""
    n = F.least(F.size(c), F.lit(length))
    zeros = F.array_repeat(F.lit(0.0), F.lit(length) - n)
    return F.concat(F.slice(c, 1, length), zeros), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def _rng(seed: int, key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{key}".encode()).digest()[:8], "little"))


def augment(x: np.ndarray, rng: np.random.Generator, crop: int, dropout: float = 0.1, noise: float = 0.02) -> np.ndarray:
    """A random stretch of `crop` rows (zeros behind a short one), some columns dropped, Gaussian noise added."""
    start = int(rng.integers(0, len(x) - crop + 1)) if len(x) > crop else 0
    view = np.zeros((crop, x.shape[1]), np.float32)
    part = x[start : start + crop]
    view[: len(part)] = part + rng.normal(0, noise, part.shape)
    return view * (rng.random(x.shape[1]) >= dropout)


@dataclass
class Encoder:
    """Bidirectional GRU, attention pooling, two-layer projection, unit length; weights in one dictionary."""

    w: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def new(cls, features: int, hidden: int = 32, out: int = 16, seed: int = 2025) -> Encoder:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"{d}x"] = r.normal(0, features**-0.5, (features, 3 * hidden))
            w[f"{d}h"] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            w[f"{d}b"] = np.zeros(3 * hidden)
        w["att"] = r.normal(0, (2 * hidden) ** -0.5, 2 * hidden)
        w["p1"], w["p2"] = r.normal(0, (2 * hidden) ** -0.5, (2 * hidden, hidden)), r.normal(0, hidden**-0.5, (hidden, out))
        return cls(w, hidden)

    def _gru(self, x: np.ndarray, d: str) -> np.ndarray:
        h, out, n = np.zeros(self.hidden), np.empty((len(x), self.hidden)), self.hidden
        gx = x @ self.w[f"{d}x"] + self.w[f"{d}b"]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gh = h @ self.w[f"{d}h"]
            rz = 1 / (1 + np.exp(-(gx[t, : 2 * n] + gh[: 2 * n])))
            c = np.tanh(gx[t, 2 * n :] + rz[:n] * gh[2 * n :])
            h = rz[n:] * h + (1 - rz[n:]) * c
            out[t] = h
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(2 * self.hidden)
        h = np.concatenate([self._gru(x, "f"), self._gru(x, "b")], axis=1)
        s = h @ self.w["att"]
        a = np.exp(s - s.max())
        return (a / a.sum()) @ h

    def project(self, p: np.ndarray) -> np.ndarray:
        z = np.maximum(p @ self.w["p1"], 0) @ self.w["p2"]
        return z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-9)

    def embed(self, x: np.ndarray) -> np.ndarray:
        """Zeros for an empty sequence."""
        return self.project(self.pooled(x)) if len(x) else np.zeros(self.w["p2"].shape[1])


def train_projection(enc: Encoder, seqs: list[np.ndarray], epochs: int = 5, batch: int = 32, crop: int = 16, rate: float = 0.05, temperature: float = 0.1, clip: float = 3.0, seed: int = 2025) -> list[float]:
    """Contrastive training of the projection over a bounded sample of sequences held by the caller; loss of each epoch."""
    rng, losses = np.random.default_rng(seed), []
    for epoch in range(epochs):
        total = []
        order = rng.permutation(len(seqs))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            if len(ids) < 2:
                continue
            p = np.stack([enc.pooled(augment(seqs[i], _rng(seed + epoch, f"{i}:{v}"), crop)) for v in (0, 1) for i in ids])
            a = p @ enc.w["p1"]
            hid = np.maximum(a, 0)
            z = hid @ enc.w["p2"]
            norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            u = z / norm
            s = u @ u.T / temperature
            np.fill_diagonal(s, -np.inf)
            q = np.exp(s - s.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            n = len(p)
            pos = (np.arange(n) + n // 2) % n
            loss = float(-np.log(q[np.arange(n), pos] + 1e-12).mean())
            if not np.isfinite(loss):
                continue
            total.append(loss)
            g = q.copy()
            g[np.arange(n), pos] -= 1
            du = (g + g.T) @ u / (temperature * n)
            dz = (du - u * (du * u).sum(1, keepdims=True)) / norm
            g2, dh = hid.T @ dz, dz @ enc.w["p2"].T * (a > 0)
            g1 = p.T @ dh
            scale = min(1.0, clip / (np.sqrt((g1**2).sum() + (g2**2).sum()) + 1e-12))
            enc.w["p1"] -= rate * scale * g1
            enc.w["p2"] -= rate * scale * g2
        losses.append(float(np.mean(total)) if total else float("nan"))
    return losses


def _gru_steps(w: dict[str, np.ndarray], x: np.ndarray, d: str, n: int) -> tuple[np.ndarray, list[tuple]]:
    """Outputs (rows, steps, n) of one direction over a batch of sequences, and what each step must remember."""
    h, out, kept = np.zeros((len(x), n)), np.empty((*x.shape[:2], n)), []
    gx = x @ w[f"{d}x"] + w[f"{d}b"]
    for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
        gh = h @ w[f"{d}h"]
        rz = 1 / (1 + np.exp(-(gx[:, t, : 2 * n] + gh[:, : 2 * n])))
        c = np.tanh(gx[:, t, 2 * n :] + rz[:, :n] * gh[:, 2 * n :])
        kept.append((t, h, rz, c, gh[:, 2 * n :]))
        h = rz[:, n:] * h + (1 - rz[:, n:]) * c
        out[:, t] = h
    return out, kept


def _gru_back(w: dict[str, np.ndarray], x: np.ndarray, d: str, n: int, kept: list[tuple], dout: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Add the gradients of one direction, last step first."""
    back = np.zeros((len(x), n))
    for t, h, rz, c, ghc in reversed(kept):
        dh = dout[:, t] + back
        r, z = rz[:, :n], rz[:, n:]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * ghc * r * (1 - r)
        dx = np.concatenate([dr, dz, dc], axis=1)
        dgh = np.concatenate([dr, dz, dc * r], axis=1)
        g[f"{d}x"] += x[:, t].T @ dx
        g[f"{d}b"] += dx.sum(0)
        g[f"{d}h"] += h.T @ dgh
        back = dh * z + dgh @ w[f"{d}h"].T


def loss_and_gradients(enc: Encoder, views: np.ndarray, temperature: float = 0.1, keep: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Symmetric contrastive loss of 2 * n views, (steps, features) each, the i-th and (i + n)-th of one sequence; and its gradients.

    keep: a mask with its scale on the recurrent outputs (dropout), or none.
    """
    w, n = enc.w, enc.hidden
    g = {k: np.zeros_like(v) for k, v in w.items()}
    (hf, kf), (hb, kb) = (_gru_steps(w, views, d, n) for d in "fb")
    h = np.concatenate([hf, hb], axis=2)
    h = h if keep is None else h * keep
    s = h @ w["att"]
    a = np.exp(s - s.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    p = (a[:, :, None] * h).sum(1)
    hid = np.maximum(p @ w["p1"], 0)
    z = hid @ w["p2"]
    norm = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    u = z / norm
    m = len(u)
    sim = u @ u.T / temperature
    np.fill_diagonal(sim, -np.inf)
    top = sim.max(1, keepdims=True)
    q = np.exp(sim - top)
    total = q.sum(1, keepdims=True)
    pos = (np.arange(m) + m // 2) % m
    loss = float((np.log(total[:, 0]) + top[:, 0] - sim[np.arange(m), pos]).mean())
    q /= total
    q[np.arange(m), pos] -= 1
    du = (q + q.T) @ u / (temperature * m)
    dz = (du - u * (du * u).sum(1, keepdims=True)) / norm
    g["p2"] += hid.T @ dz
    dhid = dz @ w["p2"].T * (hid > 0)
    g["p1"] += p.T @ dhid
    dp = dhid @ w["p1"].T
    da = (h * dp[:, None, :]).sum(2)
    ds = a * (da - (a * da).sum(1, keepdims=True))
    g["att"] += (ds[:, :, None] * h).sum((0, 1))
    dh = a[:, :, None] * dp[:, None, :] + ds[:, :, None] * w["att"]
    dh = dh if keep is None else dh * keep
    _gru_back(w, views, "f", n, kf, dh[:, :, :n], g)
    _gru_back(w, views, "b", n, kb, dh[:, :, n:], g)
    return loss, g


def train(
    enc: Encoder, seqs: list[np.ndarray], epochs: int = 10, batch: int = 128, crop: int = 64, rate: float = 3e-4, decay: float = 1e-2, temperature: float = 0.1, clip: float = 3.0, dropout: float = 0.1,
    seed: int = 2025, same_views: bool = False, checkpoint: Callable[[int, dict[str, np.ndarray], float], None] | None = None,
) -> list[float]:
    """Contrastive training of all weights over a bounded sample of sequences held by the caller; loss of each epoch.

    AdamW with clipped gradients. Empty sequences and those with numbers that aren't finite are passed over, and so are batches
    whose loss isn't. same_views: every epoch sees the views of the first one. checkpoint is called after each epoch.
    """
    good = [i for i, x in enumerate(seqs) if len(x) and np.isfinite(x).all()]
    m, v = ({k: np.zeros_like(x) for k, x in enc.w.items()} for _ in range(2))
    rng, losses, step = np.random.default_rng(seed), [], 0
    for epoch in range(epochs):
        order, total = rng.permutation(good) if good else [], []
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            if len(ids) < 2:
                continue
            views = np.stack([augment(seqs[i], _rng(seed + (0 if same_views else epoch), f"{i}:{side}"), crop) for side in (0, 1) for i in ids]).astype(float)
            keep = (rng.random((*views.shape[:2], 2 * enc.hidden)) >= dropout) / (1 - dropout) if dropout else None
            loss, g = loss_and_gradients(enc, views, temperature, keep)
            size = np.sqrt(sum((x * x).sum() for x in g.values()))
            if not (np.isfinite(loss) and np.isfinite(size)):
                continue
            total.append(loss)
            step += 1
            for k, x in enc.w.items():
                d = g[k] * min(1.0, clip / (size + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                x -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * x)
        losses.append(float(np.mean(total)) if total else float("nan"))
        if checkpoint:
            checkpoint(epoch, enc.w, losses[-1])
    return losses


def embed_maps(rows: DataFrame, key: str, order: str, columns: list[str], enc: Encoder) -> DataFrame:
    """(key, embedding): each map's rows in order through the encoder. A map is a file's worth of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[columns].fillna(0.0).to_numpy(float)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "embedding": [enc.embed(x).astype("float32").tolist()]})

    return rows.select(key, order, *columns).groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def embed_new(rows: DataFrame, done: DataFrame, key: str, order: str, columns: list[str], enc: Encoder) -> DataFrame:
    """Resume: only the maps that `done` doesn't have."""
    return embed_maps(rows.join(done.select(key).distinct(), key, "left_anti"), key, order, columns, enc)
