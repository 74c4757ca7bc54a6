"""A learned partition of vectors in two levels: balanced graph partitioning, then a small classifier.

Follows the scheme of neural locality-sensitive hashing (Dong, Indyk, Razenshteyn,
Wagner 2020): a k-nearest-neighbour graph of a sample is cut into parts of equal
size with few edges between them, and a classifier learns to tell the parts of a
vector and of its neighbours from the vector alone.  A first router tells the
regions apart, and each region has a router of its own for its parts, so that
the number of parts can follow the number of vectors while every router is
fitted on a bounded sample, in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def neighbour_graph(x: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """(n, k) indices of the most similar rows of unit vectors, by brute force in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), dtype=np.int64)
    for at in range(0, n, block):
        s = x[at : at + block] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + block] = np.argpartition(s, n - k, axis=1)[:, n - k :] if k else 0
    return out


def _seed_parts(x: np.ndarray, parts: int, cap: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced first assignment: nearest of ``parts`` centres with room left, surest rows first."""
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(4):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    sims = x @ centres.T
    return _fill(sims, cap)


def _fill(wish: np.ndarray, cap: int) -> np.ndarray:
    """Each row's best column that has room, rows in order of how clear their wish is."""
    ranked = np.argsort(-wish, axis=1, kind="stable")
    best = np.take_along_axis(wish, ranked[:, :1], axis=1)[:, 0]
    room = np.full(wish.shape[1], cap)
    out = np.empty(len(wish), dtype=np.int64)
    for i in np.argsort(-best, kind="stable"):
        for p in ranked[i]:
            if room[p]:
                room[p] -= 1
                out[i] = p
                break
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.1, seed: int = 7) -> np.ndarray:
    """Parts of at most (1 + slack) n / parts nodes, by label propagation under that limit.

    A node moves to the part of most of its neighbours, in either direction of
    the graph, as long as the part has room; the surest moves go first.
    """
    n = len(x)
    cap = int(np.ceil(n / parts * (1 + slack)))
    rng = np.random.default_rng(seed)
    own = _seed_parts(x, parts, cap, rng)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.bincount(src * parts + own[dst], minlength=n * parts) + np.bincount(dst * parts + own[src], minlength=n * parts)
        votes = votes.reshape(n, parts)
        gain = votes.max(axis=1) - votes[np.arange(n), own]
        size = np.bincount(own, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(np.argmax(np.where(size < cap, votes[i], -1)))
            if votes[i, to] > votes[i, own[i]]:
                size[own[i]] -= 1
                size[to] += 1
                own[i] = to
                moved += 1
        if not moved:
            break
    return own


@dataclass
class Router:
    """Logits of the parts: a linear layer over the unit vector, and its squares' share through one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + x @ self.w3 + self.b2

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """(n, parts) logarithms of the probabilities of the parts."""
        z = self.logits(x)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def packed(self) -> "Router":
        """The same in half the bytes, for a broadcast."""
        return Router(*(t.astype(np.float16) for t in (self.w1, self.b1, self.w2, self.b2, self.w3)))

    def unpacked(self) -> "Router":
        return Router(*(t.astype(np.float32) for t in (self.w1, self.b1, self.w2, self.b2, self.w3)))


def best(z: np.ndarray, m: int) -> np.ndarray:
    """(n, m) columns with the largest values of each row, largest first."""
    m = min(m, z.shape[1])
    at = np.argpartition(-z, m - 1, axis=1)[:, :m]
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(z, at, axis=1), axis=1, kind="stable"), axis=1)


class TwoLevels:
    """A router to regions and one router in each region; parts are numbered region by region.

    A part is weighed by the probability of its region times its own in the
    region; the parts of the ``wide`` most probable regions are weighed.
    """

    def __init__(self, regions: Router, low: list[Router], wide: int = 4):
        self.regions, self.low, self.wide = regions, [r.packed() for r in low], wide
        self.first = np.concatenate([[0], np.cumsum([r.parts for r in low])])

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def top(self, x: np.ndarray, m: int) -> np.ndarray:
        """(n, m) parts, most probable first; -1 where a row's regions have fewer than m."""
        z = self.regions.log_shares(x)
        seen = best(z, self.wide)
        m = min(m, self.parts)
        share = np.full((len(x), seen.shape[1], m), -np.inf, dtype=np.float32)
        part = np.full((len(x), seen.shape[1], m), -1, dtype=np.int64)
        for region in np.unique(seen):
            row, place = np.nonzero(seen == region)
            s = self.low[region].unpacked().log_shares(x[row])
            cols = best(s, m)
            share[row, place, : cols.shape[1]] = np.take_along_axis(s, cols, axis=1) + z[row, region][:, None]
            part[row, place, : cols.shape[1]] = cols + self.first[region]
        share, part = share.reshape(len(x), -1), part.reshape(len(x), -1)
        return np.take_along_axis(part, best(share, m), axis=1)


def train_router(x: np.ndarray, graph: np.ndarray, own: np.ndarray, parts: int, hidden: int = 128, epochs: int = 12, batch: int = 256, rate: float = 3e-3, seed: int = 11) -> Router:
    """Softmax over the parts, fitted by Adam to the mean of a node's own part and its neighbours' parts."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    near = np.concatenate([own[:, None], own[graph]], axis=1) if graph.size else own[:, None]
    shapes = [(dim, hidden), (hidden,), (hidden, parts), (parts,), (dim, parts)]
    theta = [(rng.standard_normal(s) * (1 / np.sqrt(max(s[0], 1)) if len(s) > 1 else 0)).astype(np.float32) for s in shapes]
    theta[0] *= np.float32(np.sqrt(dim))  # with hidden = 0 only the linear layer is left
    m1, m2, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    rows = np.arange(batch)[:, None]
    for epoch in range(epochs):
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            xb = x[pick]
            target = np.zeros((len(pick), parts), dtype=np.float32)
            np.add.at(target, (rows[: len(pick)], near[pick]), np.float32(1 / near.shape[1]))
            h = np.maximum(xb @ theta[0] + theta[1], 0)
            z = h @ theta[2] + xb @ theta[4] + theta[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (e / e.sum(axis=1, keepdims=True) - target) / len(pick)
            dh = (dz @ theta[2].T) * (h > 0)
            grads = [xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0), xb.T @ dz]
            step += 1
            for t, g, a, b in zip(theta, grads, m1, m2):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                t -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Router(theta[0], theta[1], theta[2], theta[3], theta[4])


def fit_router(x: np.ndarray, parts: int, k: int = 10, **training) -> Router:
    """Fit on unit vectors; one part if the sample is too small for more."""
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        dim = x.shape[1]
        zero = lambda *s: np.zeros(s, dtype=np.float32)
        return Router(zero(dim, 1), zero(1), zero(1, 1), zero(1), zero(dim, 1))
    graph = neighbour_graph(x, k)
    return train_router(x, graph, balanced_parts(x, graph, parts), parts, **training)
