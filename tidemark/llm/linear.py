"""Hashed text features and a linear hinge-loss model fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes that are worked on at once; longer texts go through in overlapping stretches.
STRETCH = 1 << 18
#: Bytes of several texts that are scored at once: each takes a number for each model.
GROUP = 1 << 16


def byte_ngrams(raw: np.ndarray, order: int, dims: int) -> np.ndarray:
    """Hash codes below ``dims`` (a power of two) of all byte n-grams of one order, by start position."""
    n = len(raw) - order + 1
    code = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(order):
        code = (code ^ raw[k : k + n].astype(np.uint32)) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
    return (code & np.uint32(dims - 1)).astype(np.int32)


def stretches(raw: bytes, order: int) -> Iterator[np.ndarray]:
    """``raw`` as arrays whose n-gram starts cover each start once."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, max(1, len(whole)), STRETCH):
        yield whole[at : at + STRETCH + order - 1]


def ngram_frequencies(raw: bytes, orders: tuple[int, ...], dims: int) -> np.ndarray:
    """Relative frequencies of hashed n-grams, all orders in one vector; zeros for too short a text."""
    total = np.zeros(dims, dtype=np.float64)
    for order in orders:
        for part in stretches(raw, order):
            total += np.bincount(byte_ngrams(part, order, dims), minlength=dims)
    return (total / max(1.0, total.sum())).astype(np.float32)


def batch_scores(texts: list[bytes], orders: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """Frequencies times ``weights`` (dims, models), a row per text, without building the frequencies."""
    dims, models = weights.shape
    sums, counts = np.zeros((len(texts), models)), np.zeros(len(texts))
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) < GROUP):
            group.append(at)
            size += len(texts[at])
            at += 1
        for order in orders:
            if len(group) == 1:
                for part in stretches(texts[group[0]], order):
                    code = byte_ngrams(part, order, dims)
                    sums[group[0]] += weights[code].sum(axis=0, dtype=np.float64)
                    counts[group[0]] += len(code)
                continue
            rows = [g for g in group if len(texts[g]) >= order]
            if not rows:
                continue
            code = byte_ngrams(np.frombuffer(b"".join(texts[g] for g in rows), dtype=np.uint8), order, dims)
            value = np.zeros((len(code) + order, models))
            value[: len(code)] = weights[code]
            lengths = np.array([len(texts[g]) for g in rows])
            ends = np.cumsum(lengths)
            cuts = np.ravel(np.column_stack([ends - lengths, ends - order + 1]))  # starts of n-grams inside one text
            sums[rows] += np.add.reduceat(value, cuts, axis=0)[::2]
            counts[rows] += lengths - order + 1
    return sums / np.maximum(1.0, counts)[:, None]


def fit_hinge(rows: int, dot: Callable[[int, np.ndarray], float], add: Callable[[int, np.ndarray, float], None], norms: np.ndarray, y: np.ndarray, dims: int, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the L1 hinge loss; y is +1 or -1, cost bounds each dual variable."""
    w, alpha, rng = np.zeros(dims), np.zeros(rows), np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(rows):
            if norms[i] <= 0:
                continue
            gradient = y[i] * dot(i, w) - 1.0
            step = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                add(i, w, step * y[i])
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias; classes count alike."""
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))

    def add(i: int, w: np.ndarray, by: float) -> None:
        w[:-1] += by * x[i]
        w[-1] += by

    norms = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1
    w = fit_hinge(len(x), lambda i, w: x[i] @ w[:-1] + w[-1], add, norms, y, x.shape[1] + 1, cost * share)
    return w[:-1], float(w[-1])


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton steps, with smoothed targets; y is 0 or 1."""
    up, n = max(1.0, y.sum()), len(y)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margins).sum() + 1e-6 * a, g.sum()
        haa, hab, hbb = (h * margins**2).sum() + 1e-6, (h * margins).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - scale * da, b - scale * db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
