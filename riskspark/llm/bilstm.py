"""A small character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Printable ASCII characters have a class each; other letters one, the rest one.
CLASSES = 97


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes >= 192, 95, 96)).astype(np.int16)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_weights(hidden: int, tags: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
        w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    w["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, tags))
    w["p"], w["t"] = np.zeros(tags), np.zeros((tags, tags))
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_lstm(w, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) over classes x (batch, time)."""
    n, steps = x.shape
    hidden = len(w[f"h{d}"])
    h, c = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    out = np.empty((steps, n, hidden), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = w[f"x{d}"][x[:, t]] + h @ w[f"h{d}"] + w[f"c{d}"]
        i, f, o = (sigmoid(z[:, k * hidden:(k + 1) * hidden]) for k in range(3))
        g, c0, h0 = np.tanh(z[:, 3 * hidden:]), c, h
        c = f * c0 + i * g
        a = np.tanh(c)
        h = o * a
        out[t] = h
        if keep is not None:
            keep.append((t, i, f, o, g, c0, h0, a))
    return out


def emissions(w, x: np.ndarray) -> np.ndarray:
    """(batch, time, tags)"""
    states = np.concatenate([run_lstm(w, "f", x), run_lstm(w, "b", x)], axis=2)
    return (states @ w["o"] + w["p"]).transpose(1, 0, 2)


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def step_gradients(w, x: np.ndarray, y: np.ndarray):
    """Negative log likelihood of the tags y under the CRF, and gradients."""
    n, steps = x.shape
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([run_lstm(w, d, x, kept[d]) for d in "fb"], axis=2)
    e = states @ w["o"] + w["p"]
    tags, trans = e.shape[2], w["t"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    logz = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - logz[None, :, None])
    one = np.eye(tags, dtype=np.float32)[y.T]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    pair = np.zeros((tags, tags))
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - logz[:, None, None]).sum(0)
    np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    gold = (e * one).sum() + trans[y[:, :-1], y[:, 1:]].sum()
    de = (de - one) / n
    g["t"] = (pair / n).astype(np.float32)
    g["o"] = states.reshape(-1, states.shape[2]).T @ de.reshape(-1, tags)
    g["p"] = de.sum((0, 1))
    ds = de @ w["o"].T
    hidden = states.shape[2] // 2
    for d, part in (("f", ds[:, :, :hidden]), ("b", ds[:, :, hidden:])):
        dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
        for t, i, f, o, gg, c0, h0, a in reversed(kept[d]):
            dh = dh + part[t]
            dc = dc + dh * o * (1 - a * a)
            dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * a * o * (1 - o), dc * i * (1 - gg * gg)], 1)
            np.add.at(g[f"x{d}"], x[:, t], dz)
            g[f"h{d}"] += h0.T @ dz
            g[f"c{d}"] += dz.sum(0)
            dh, dc = dz @ w[f"h{d}"].T, dc * f
    return (logz.sum() - gold) / n, g


def train(x: np.ndarray, y: np.ndarray, tags: int, hidden: int = 12, epochs: int = 12, batch: int = 64,
          rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of windows x (n, time) with tags y."""
    w, rng = new_weights(hidden, tags, seed), np.random.default_rng(seed)
    m1, m2 = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    k = 0
    for epoch in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at:at + batch]
            _, g = step_gradients(w, x[some], y[some])
            k += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for n in w:
                m1[n] = 0.9 * m1[n] + 0.1 * g[n]
                m2[n] = 0.99 * m2[n] + 0.01 * g[n] ** 2
                w[n] = (w[n] - lr * (m1[n] / (1 - 0.9 ** k)) / (np.sqrt(m2[n] / (1 - 0.99 ** k)) + 1e-8)).astype(np.float32)
    return w


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags for emissions (batch, time, tags)."""
    n, steps, tags = e.shape
    score, back = e[:, 0], np.zeros((steps, n, tags), np.int8)
    for t in range(1, steps):
        s = score[:, :, None] + trans
        back[t] = s.argmax(1)
        score = s.max(1) + e[:, t]
    out = np.empty((n, steps), np.int8)
    out[:, -1] = score.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out
