"""Recurrent cells in numpy: forward passes, backpropagation through time and Adam.

Arrays are feature-major: a state is (hidden, batch) and inputs are (time, batch) symbols, whose contribution to the
gates is a column of a table. All weights are float32.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, F32(0.5), out=x)
    np.tanh(x, out=x)
    x *= F32(0.5)
    x += F32(0.5)
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, clip: float = 5.0):
        self.w, self.rate, self.clip, self.t = weights, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, self.clip / (norm + 1e-9))
        rate = (self.rate if rate is None else rate) * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * F32(scale)
            self.m[k] += F32(0.1) * (g - self.m[k])
            self.v[k] += F32(0.001) * (g * g - self.v[k])
            self.w[k] -= F32(rate) * self.m[k] / (np.sqrt(self.v[k]) + F32(1e-8))


def gru_weights(rng: np.random.Generator, symbols: int, hidden: int, prefix: str) -> dict[str, np.ndarray]:
    """x: (3H, symbols) for update, reset, candidate; u: (3H, H); n: (H, 1), the bias inside the reset product."""
    return {
        f"{prefix}x": rng.normal(0, 0.3, (3 * hidden, symbols)).astype(F32),
        f"{prefix}u": rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(F32),
        f"{prefix}n": np.zeros((hidden, 1), F32),
    }


def gru_step(w: dict, p: str, x: np.ndarray, h: np.ndarray, mask: np.ndarray | None = None) -> tuple:
    """One step; the state is 0 where mask is 0. Returns the new state and what the backward pass needs."""
    n = len(h)
    a = np.take(w[p + "x"], x, axis=1)
    g = w[p + "u"] @ h
    zr = sigmoid(a[: 2 * n] + g[: 2 * n])
    inner = g[2 * n :]
    inner += w[p + "n"]
    cand = np.tanh(a[2 * n :] + zr[n:] * inner)
    new = cand + zr[:n] * (h - cand)
    if mask is not None:
        new *= mask
    return new, (h, zr, inner, cand, x, mask)


def gru_back(w: dict, p: str, dh: np.ndarray, saved: tuple, grads: dict) -> np.ndarray:
    """Gradient of the state before; adds to grads. Gradients of the input table go to grads[p + 'x'] by symbol."""
    h, zr, inner, cand, x, mask = saved
    n = len(h)
    if mask is not None:
        dh = dh * mask
    z, r = zr[:n], zr[n:]
    dcand = dh * (1 - z) * (1 - cand * cand)
    dg = np.empty((3 * n, dh.shape[1]), F32)
    dg[:n] = dh * (h - cand) * z * (1 - z)
    dg[n : 2 * n] = dcand * inner * r * (1 - r)
    dg[2 * n :] = dcand
    add_columns(grads[p + "x"], x, dg)
    dg[2 * n :] *= r
    grads[p + "n"] += dg[2 * n :].sum(axis=1, keepdims=True)
    grads[p + "u"] += dg @ h.T
    return dh * z + w[p + "u"].T @ dg


def add_columns(table: np.ndarray, x: np.ndarray, values: np.ndarray) -> None:
    """table[:, x] += values, repeats included."""
    order = np.argsort(x, kind="stable")
    xs = x[order]
    starts = np.flatnonzero(np.append(True, xs[1:] != xs[:-1]))
    table[:, xs[starts]] += np.add.reduceat(values[:, order], starts, axis=1)


def lstm_weights(rng: np.random.Generator, symbols: int, hidden: int, prefix: str) -> dict[str, np.ndarray]:
    """x: (4H, symbols) for forget, input, output, candidate, forget biased to 1; u: (4H, H)."""
    x = rng.normal(0, 0.3, (4 * hidden, symbols)).astype(F32)
    x[:hidden] += 1
    return {f"{prefix}x": x, f"{prefix}u": rng.normal(0, 1 / np.sqrt(hidden), (4 * hidden, hidden)).astype(F32)}


def lstm_step(w: dict, p: str, x: np.ndarray, h: np.ndarray, c: np.ndarray, mask: np.ndarray | None = None) -> tuple:
    n = len(h)
    g = w[p + "u"] @ h
    g += np.take(w[p + "x"], x, axis=1)
    sigmoid(g[: 3 * n])
    np.tanh(g[3 * n :], out=g[3 * n :])
    new_c = g[:n] * c
    new_c += g[n : 2 * n] * g[3 * n :]
    if mask is not None:
        new_c *= mask
    t = np.tanh(new_c)
    new_h = t * g[2 * n : 3 * n]
    return new_h, new_c, (h, c, g, t, x, mask)


def lstm_back(w: dict, p: str, dh: np.ndarray, dc: np.ndarray, saved: tuple, grads: dict) -> tuple:
    h, c, g, t, x, mask = saved
    n = len(h)
    f, i, o, q = g[:n], g[n : 2 * n], g[2 * n : 3 * n], g[3 * n :]
    dc = dc + dh * o * (1 - t * t)
    if mask is not None:
        dc = dc * mask
    dg = np.empty((4 * n, dh.shape[1]), F32)
    dg[:n] = dc * c * f * (1 - f)
    dg[n : 2 * n] = dc * q * i * (1 - i)
    dg[2 * n : 3 * n] = dh * t * o * (1 - o)
    dg[3 * n :] = dc * i * (1 - q * q)
    add_columns(grads[p + "x"], x, dg)
    grads[p + "u"] += dg @ h.T
    return w[p + "u"].T @ dg, dc * f


def windows(sizes: np.ndarray, core: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts sequences that lie one after the other into windows of core symbols with context on either side.

    Returns per window its sequence, where its core begins, and the bounds of its sequence (positions in the whole).
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    counts = -(-sizes // core)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, begins[owner] + nth * core, begins[owner], ends[owner]


def framed(symbols: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, core: int, context: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) symbols, pad outside of the sequence, and the mask of what is inside."""
    at = start[None, :] - context + np.arange(core + 2 * context)[:, None]
    inside = (at >= low) & (at < high)
    x = np.where(inside, symbols[np.clip(at, 0, len(symbols) - 1)], pad)
    return x.astype(np.int32), inside
