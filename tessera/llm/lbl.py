"""Log-bilinear model in numpy: context vectors, position matrices, outputs in two levels, noise-contrastive training.

The context of a token is the `CONTEXT` items before it (the end stands for what lies before a text). Their vectors,
each times the matrix of its position, add up to a predicted vector h. The class of the token has score h . A[c] + a[c]
among all classes, the item within its class has score h . Q[i] + b[i] among the class's items; so a token's probability
is normalised exactly by two batched matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CONTEXT = 3
DIMENSION = 16
#: Noise draws a batch for classes, and a token for items.
CLASS_NOISE, ITEM_NOISE = 48, 1
BATCH = 1024
RATE = 0.05
NAMES = ("R", "A", "Q", "C")


@dataclass
class Layout:
    """Items lie class by class: the items of class c are first[c] to first[c + 1]. counts: occurrences of items, at least 1."""

    first: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.classes, self.items = len(self.first) - 1, int(self.first[-1])
        self.class_of = np.repeat(np.arange(self.classes), np.diff(self.first))
        self.sums = np.concatenate([[0.0], np.cumsum(self.counts, dtype=np.float64)])
        by_class = np.diff(self.sums[self.first])
        self.class_log = np.log(by_class / self.sums[-1]).astype(np.float32)
        self.item_log = (np.log(self.counts) - np.log(by_class)[self.class_of]).astype(np.float32)


class Net:
    """Rows of A and Q end with their bias, so they have one column more than the dimension. squares: of each row's gradients so far."""

    def __init__(self, layout: Layout, dimension: int = DIMENSION, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.R = rng.normal(0, 0.3, (layout.items, dimension)).astype(np.float32)
        self.C = np.stack([np.eye(dimension, dtype=np.float32) / (k + 1) for k in range(CONTEXT)]).reshape(-1, dimension)
        self.A = np.concatenate([np.zeros((layout.classes, dimension), np.float32), layout.class_log[:, None]], axis=1)
        self.Q = np.concatenate([np.zeros((layout.items, dimension), np.float32), layout.item_log[:, None]], axis=1)
        self.dimension = dimension
        self.squares = {k: np.full(len(getattr(self, k)), 1e-2, np.float32) for k in NAMES}

    def tables(self) -> list[np.ndarray]:
        """Context vectors times the matrix of each position; their last columns add up to 1, for the biases."""
        last = np.full((len(self.R), 1), 1 / CONTEXT, np.float32)
        return [np.concatenate([self.R @ self.position(k), last], axis=1) for k in range(CONTEXT)]

    def position(self, k: int) -> np.ndarray:
        return self.C[k * self.dimension : (k + 1) * self.dimension]


def contexts(items: np.ndarray, off: np.ndarray, end: int) -> np.ndarray:
    """(tokens, CONTEXT): the items before each token of its text, the nearest first."""
    out = np.full((len(items), CONTEXT), end, np.int64)
    place = np.arange(len(items)) - np.repeat(off[:-1], np.diff(off))
    for k in range(CONTEXT):
        out[k + 1 :, k] = items[: max(len(items) - k - 1, 0)]
        out[place <= k, k] = end
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation by Adagrad over batches; uses counts how often each row was trained."""

    def __init__(self, net: Net, layout: Layout, seed: int, rate: float = RATE, size: int = BATCH):
        self.net, self.layout, self.rate, self.size = net, layout, rate, size
        self.rng = np.random.default_rng(seed)
        self.uses = {k: np.zeros(len(getattr(net, k))) for k in NAMES}
        self.class_sums = layout.sums[layout.first]

    def _step(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """Add grad to the given rows, which may repeat."""
        small = rows.astype(np.uint16) if len(getattr(self.net, name)) <= 1 << 16 else rows  # sorted by radix
        order = np.argsort(small, kind="stable")
        rows = rows[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        self._add(name, rows[start], np.add.reduceat(grad[order], start, axis=0), np.diff(np.append(start, len(rows))))

    def _add(self, name, rows, grad, uses) -> None:
        square = self.net.squares[name]
        square[rows] += (grad * grad).mean(axis=1)
        getattr(self.net, name)[rows] += self.rate * grad / np.sqrt(square[rows])[:, None]
        self.uses[name][rows] += uses

    def batch(self, ctx: np.ndarray, item: np.ndarray) -> None:
        net, lay, n, d = self.net, self.layout, len(item), self.net.dimension
        vectors = [net.R[ctx[:, k]] for k in range(CONTEXT)]
        h = np.ones((n, d + 1), np.float32)
        h[:, :d] = sum(v @ net.position(k) for k, v in enumerate(vectors))
        cls = lay.class_of[item]

        # Classes: the draws are shared by the batch.
        drawn = np.searchsorted(self.class_sums, self.rng.random(CLASS_NOISE) * lay.sums[-1], side="right") - 1
        log_k = np.float32(np.log(CLASS_NOISE))
        A = net.A[cls]
        good = 1 - _sigmoid(np.einsum("nd,nd->n", h, A) - log_k - lay.class_log[cls])
        N = net.A[drawn]
        bad = -_sigmoid(h @ N.T - log_k - lay.class_log[drawn])

        # Items: the draws are of the token's class.
        low, high = lay.sums[lay.first[cls]], lay.sums[lay.first[cls + 1]]
        draws = np.searchsorted(lay.sums, low[:, None] + self.rng.random((n, ITEM_NOISE)) * (high - low)[:, None], side="right") - 1
        ids = np.concatenate([item[:, None], np.clip(draws, lay.first[cls][:, None], lay.first[cls + 1][:, None] - 1)], axis=1)
        Q = net.Q[ids]
        g = -_sigmoid(np.einsum("nd,nkd->nk", h, Q) - np.float32(np.log(ITEM_NOISE)) - lay.item_log[ids])
        g[:, 0] += 1
        self._step("Q", ids.ravel(), (g[:, :, None] * h[:, None, :]).reshape(-1, d + 1))
        self._step("A", np.concatenate([cls, drawn]), np.concatenate([good[:, None] * h, bad.T @ h]))
        back = (good[:, None] * A + bad @ N + np.einsum("nk,nkd->nd", g, Q))[:, :d]
        turned = np.concatenate([v.T @ back for v in vectors]) / np.float32(np.sqrt(n))
        self._step("R", ctx.T.ravel(), np.concatenate([back @ net.position(k).T for k in range(CONTEXT)]))
        self._add("C", np.arange(len(net.C)), turned, np.full(len(net.C), n))

    def texts(self, items: np.ndarray, off: np.ndarray, end: int) -> None:
        ctx = contexts(items, off, end)
        order = self.rng.permutation(len(items))
        for a in range(0, len(order), self.size):
            self.batch(ctx[order[a : a + self.size]], items[order[a : a + self.size]])


class Scorer:
    """Normalised log10 probabilities; the products of vectors and position matrices are made once."""

    def __init__(self, net: Net, layout: Layout):
        self.layout, self.net = layout, net
        self.tables = net.tables()

    def logs(self, ctx: np.ndarray, item: np.ndarray, block: int = 1 << 16, part: int = 1 << 11) -> np.ndarray:
        """Of each token; classes in parts that fit the cache, items class by class."""
        out = np.empty(len(item))
        net, lay = self.net, self.layout
        outputs = np.ascontiguousarray(net.A.T)
        for a in range(0, len(item), block):
            it = item[a : a + block]
            cls = lay.class_of[it]
            h = sum(t[ctx[a : a + block, k]] for k, t in enumerate(self.tables))
            p = np.concatenate([_picked(h[k : k + part] @ outputs, cls[k : k + part]) for k in range(0, len(it), part)])
            order = np.argsort(cls.astype(np.uint16), kind="stable")
            h, it, cls = h[order], it[order], cls[order]
            start = 0
            for e in (np.flatnonzero(np.diff(cls, append=-1)) + 1).tolist():
                i, j = lay.first[cls[start]], lay.first[cls[start] + 1]
                if j - i > 1:
                    p[order[start:e]] += _picked(h[start:e] @ net.Q[i:j].T, it[start:e] - i)
                start = e
            out[a : a + block] = p
        return out / np.log(10)


def _picked(s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Log softmax of rows at the columns k."""
    top = s.max()
    if top > 60:
        s -= top
    picked = s[np.arange(len(k)), k]
    sums = np.exp(s) @ np.ones(s.shape[1], s.dtype)
    low = np.flatnonzero(sums < 1e-30)  # far below the greatest of all
    if len(low):
        top = s[low].max(axis=1, keepdims=True)
        out = picked - np.log(np.maximum(sums, 1e-30))
        out[low] = picked[low] - top[:, 0] - np.log(np.exp(s[low] - top).sum(axis=1))
        return out
    return picked - np.log(sums)
