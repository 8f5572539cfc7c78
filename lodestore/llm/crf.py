"""A linear-chain conditional random field with labels 0 and 1 over many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps of a sequence that are walked as one block.
BLOCK = 64


def _walk(e: np.ndarray, at: np.ndarray, a: np.ndarray) -> np.ndarray:
    """P(label 1 | what came before and here) for each place; e: exp(score of 1 over 0); a: 2x2 transition potentials.

    Blocks of all sequences advance together: first each block's 2x2 product, then the chain of blocks of each
    sequence, then the places inside. A sequence starts with equal odds.
    """
    lens = np.diff(at)
    blocks = -(-lens // BLOCK)
    n = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    seq = np.repeat(np.arange(len(lens)), blocks)
    k = np.arange(n) - first[seq]
    begin = at[seq] + k * BLOCK
    size = np.minimum(BLOCK, at[seq + 1] - begin)
    index = begin[None] + np.arange(BLOCK)[:, None]
    real = np.arange(BLOCK)[:, None] < size[None]
    grid = np.where(real, e[np.minimum(index, len(e) - 1)], 1.0)
    head = k == 0

    def step(t: int) -> tuple:
        if t:
            return a[0, 0], a[0, 1], a[1, 0], a[1, 1]
        return tuple(np.where(head, 1.0, x) for x in a.ravel())

    p = np.array([np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)])
    for t in range(BLOCK):
        a00, a01, a10, a11 = step(t)
        q = np.array([p[0] * a00 + p[1] * a10, (p[0] * a01 + p[1] * a11) * grid[t], p[2] * a00 + p[3] * a10, (p[2] * a01 + p[3] * a11) * grid[t]])
        q /= q.sum(axis=0)
        p = np.where(real[t], q, p)
    order = np.argsort(-blocks, kind="stable")
    state = np.full((2, len(lens)), 0.5)
    entry = np.empty((2, n))
    for j in range(int(blocks.max(initial=0))):
        s = order[: int((blocks > j).sum())]
        b = first[s] + j
        entry[:, b] = state[:, s]
        new = np.array([state[0, s] * p[0, b] + state[1, s] * p[2, b], state[0, s] * p[1, b] + state[1, s] * p[3, b]])
        state[:, s] = new / new.sum(axis=0)
    out = np.empty((BLOCK, n))
    x = entry
    for t in range(BLOCK):
        a00, a01, a10, a11 = step(t)
        y = np.array([x[0] * a00 + x[1] * a10, (x[0] * a01 + x[1] * a11) * grid[t]])
        y /= y.sum(axis=0)
        x = np.where(real[t], y, x)
        out[t] = x[1]
    flat = np.empty(len(e))
    flat[index[real]] = out[real]
    return flat


def _backwards(at: np.ndarray) -> np.ndarray:
    lens = np.diff(at)
    return np.repeat(at[1:] + at[:-1] - 1, lens) - np.arange(at[-1])


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return np.log(p) - np.log1p(-p)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def messages(score: np.ndarray, at: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages, each with the place's own evidence, and the marginals of label 1."""
    if not len(score):
        return score, score, score
    e = np.exp(np.clip(score, -30, 30))
    back = _backwards(at)
    f, b = _walk(e, at, a), _walk(e[back], at, a.T)[back]
    return f, b, sigmoid(_odds(f) + _odds(b) - np.clip(score, -30, 30))


@dataclass
class Crf:
    """Weights of one-hot features (label 1 over 0) and 2x2 log transition potentials."""

    weights: np.ndarray
    transitions: np.ndarray

    def marginals(self, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        return messages(score, at, np.exp(self.transitions))[2]


def emissions(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The score of each place: the sum of its features' weights, a feature at a time to spare memory."""
    out = np.zeros(len(features))
    for k in range(features.shape[1]):
        out += w[features[:, k]]
    return out


def fit(features: np.ndarray, labels: np.ndarray, at: np.ndarray, size: int, steps: int = 60, rate: float = 0.25, decay: float = 1e-3, kind: np.ndarray | None = None, start: Crf | None = None) -> Crf:
    """Maximise the conditional log-likelihood by Adam on whole-sample gradients.

    features: (places, k) indices below size, of features that are 1; labels: 0 or 1, or the probability of 1; at:
    where sequences begin, and the end. With `kind` the features are those of kinds of places, and kind tells each
    place's. Weights start from those of `start`, if given.
    """
    w, tr = (start.weights.copy(), start.transitions.copy()) if start else (np.zeros(size), np.zeros((2, 2)))
    y = labels.astype(float)
    joint = np.ones(max(len(y) - 1, 0), bool)
    joint[at[1:-1] - 1] = False
    first, then = y[:-1][joint], y[1:][joint]
    seen = np.array([[((1 - first) * (1 - then)).sum(), ((1 - first) * then).sum()], [(first * (1 - then)).sum(), (first * then).sum()]])
    m = [np.zeros_like(w), np.zeros_like(tr)]
    v = [np.zeros_like(w), np.zeros_like(tr)]
    for t in range(1, steps + 1):
        a = np.exp(tr)
        score = emissions(w, features)
        f, b, p = messages(score if kind is None else score[kind], at, a)
        off = y - p if kind is None else np.bincount(kind, y - p, minlength=len(features))
        grad_w = sum(np.bincount(features[:, k], off, minlength=size) for k in range(features.shape[1])) / len(y) - decay * w / size
        x = np.stack([1 - f[:-1], f[:-1]])[:, None] * a[:, :, None] * np.stack([1 - b[1:], b[1:]])[None]
        x = (x / x.sum(axis=(0, 1)))[:, :, joint].sum(axis=2)
        grad_t = (seen - x) / len(y) - decay * tr / 4
        for i, (theta, g) in enumerate(((w, grad_w), (tr, grad_t))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta += rate * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    return Crf(w, tr)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 0.1) -> np.ndarray:
    """Slopes and intercept that turn a document's evidence (a number or a row each) into the probability of label 1.

    Newton steps on evidence of unit spread, halved until the penalised likelihood rises.
    """
    x = np.reshape(x, (len(y), -1))
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    pull = ridge * np.diag([1.0] * x.shape[1] + [1e-3])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0.5, -1, 1) * (z @ w)).sum() + w @ pull @ w / 2)

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pull + 1e-9 * np.eye(len(w)), z.T @ (y - p) - pull @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = w[:-1] / spread
    return np.append(slope, w[-1] - slope @ mean)
