"""Training of the recurrent encoder: gradients against differences, falling losses, checkpoints."""

import numpy as np

from rondo.operators import sequences as Q


def test_gradients():
    rng = np.random.default_rng(1)
    enc = Q.Encoder.new(3, hidden=4, out=5, seed=2)
    views = rng.normal(size=(6, 7, 3))
    keep = (rng.random((6, 7, 8)) >= 0.2) / 0.8
    for mask in (None, keep):
        _, g = Q.loss_and_gradients(enc, views, 0.5, mask)
        for k, w in enc.w.items():
            flat = w.reshape(-1)
            for at in rng.choice(flat.size, min(6, flat.size), replace=False):
                old, eps = flat[at], 1e-6
                flat[at] = old + eps
                up = Q.loss_and_gradients(enc, views, 0.5, mask)[0]
                flat[at] = old - eps
                down = Q.loss_and_gradients(enc, views, 0.5, mask)[0]
                flat[at] = old
                assert abs((up - down) / (2 * eps) - g[k].reshape(-1)[at]) < 1e-5, k


def test_batch_and_single_pass_agree():
    enc = Q.Encoder.new(3, hidden=4, out=5)
    x = np.random.default_rng(3).normal(size=(2, 9, 3))
    for d in "fb":
        out, _ = Q._gru_steps(enc.w, x, d, 4)
        assert np.allclose(out[1], enc._gru(x[1], d))


def test_training_lowers_the_loss_and_keeps_checkpoints():
    rng = np.random.default_rng(5)
    seqs = [np.cumsum(rng.normal(size=(30, 2)), axis=0) * 0.1 + rng.normal(size=2) for _ in range(24)] + [np.zeros((0, 2)), np.full((5, 2), np.nan)]
    enc, seen = Q.Encoder.new(2, hidden=8, out=6), []
    losses = Q.train(enc, seqs, epochs=12, batch=12, crop=12, rate=1e-2, checkpoint=lambda e, w, loss: seen.append((e, loss, w["fh"].copy())))
    assert losses[-1] < 0.8 * losses[0] and [e for e, _, _ in seen] == list(range(12))
    assert not np.allclose(seen[0][2], seen[-1][2])
    again = Q.train(Q.Encoder.new(2, hidden=8, out=6), seqs, epochs=12, batch=12, crop=12, rate=1e-2)
    assert np.allclose(losses, again)
    assert np.isnan(Q.train(Q.Encoder.new(2), [], epochs=1)[0])
