"""Density peaks of many segments: nearest neighbours by blocks, never the square of their number.

Points are laws of segments, in order. Means over blocks of levels are never
further apart than the laws, so they tell which few pairs need their exact
distance; a block of rows is held at a time.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np

#: Distances below this are equal to twelve digits: the segments have one law.
EQUAL = 5e-13


def quantile_profiles(v: list[np.ndarray], levels: int) -> np.ndarray:
    """``arrays.quantile_profile`` of each sorted sample, a row each; an empty one is NaN."""
    out = np.empty((len(v), levels))
    at_of = (np.arange(levels) + 0.5) / float(levels)
    sizes = np.array([len(x) for x in v])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if not n:
            out[rows] = np.nan
            continue
        at = np.minimum(np.maximum(at_of * n - 0.5, 0.0), float(n - 1))
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        for lo in range(0, len(rows), 1024):
            x = np.stack([v[i] for i in rows[lo : lo + 1024]]).astype(float)
            out[rows[lo : lo + 1024]] = x[:, low] + (at - low) * (x[:, high] - x[:, low])
    return out


def sample_law(x: np.ndarray) -> bytes:
    """What samples of one law share, whatever their sizes."""
    value, count = np.unique(x + 0.0, return_counts=True)
    return value.tobytes() + (count // np.gcd.reduce(count)).tobytes()


def distinct(keys) -> tuple[np.ndarray, np.ndarray]:
    """(first of each key, number of each one's key), in first-occurrence order. Digests are kept, not the keys."""
    seen, first, which = {}, [], []
    for i, key in enumerate(keys):
        which.append(seen.setdefault(hashlib.sha256(key).digest(), len(first)))
        if which[-1] == len(first):
            first.append(i)
    return np.array(first, int), np.array(which, int)


def block_means(x: np.ndarray, blocks: int) -> np.ndarray:
    """Means of a sorted sample's quantile function over equal blocks of levels."""
    at = np.arange(blocks + 1) * (len(x) / blocks)
    low = np.minimum(at.astype(int), len(x) - 1)
    mass = np.concatenate([[0.0], np.cumsum(x)])
    return np.diff(mass[low] + (at - low) * x[low]) * (blocks / len(x))


class Profiles:
    """W2 of equal-size profiles, one to a row."""

    def __init__(self, v: np.ndarray, blocks: int = 32):
        self.v = v
        edges = np.linspace(0, v.shape[1], min(blocks, v.shape[1]) + 1).astype(int)
        width = np.diff(edges)
        means = np.add.reduceat(v, edges[:-1], axis=1) / width
        self.low = means * np.sqrt(width / v.shape[1])

    def __len__(self):
        return len(self.v)

    def take(self, at: np.ndarray) -> Profiles:
        return Profiles(self.v[at])

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for lo in range(0, len(i), 256):  # what stays in a core's cache
            gap = self.v[j[lo : lo + 256]] - self.v[i[lo : lo + 256]]
            out[lo : lo + 256] = np.einsum("ij,ij->i", gap, gap)
        return np.sqrt(out / self.v.shape[1])


class Samples:
    """Exact W2 of sorted samples of any sizes, as ``segments.exact_w2``."""

    def __init__(self, v: list[np.ndarray], blocks: int = 32, room: int = 1 << 15):
        self.v, self.room = v, room
        self.low = np.stack([block_means(x, blocks) for x in v]) / np.sqrt(blocks)
        self.sizes = np.array([len(x) for x in v])
        self.groups, self.place = {}, np.empty(len(v), int)
        for size in np.unique(self.sizes):
            at = np.flatnonzero(self.sizes == size)
            self.groups[int(size)], self.place[at] = np.stack([v[k] for k in at]).astype(float), np.arange(len(at))

    def __len__(self):
        return len(self.v)

    def take(self, at: np.ndarray) -> Samples:
        return Samples([self.v[i] for i in at])

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at, d in self.squares(i, j):
            out[at] = d
        return np.sqrt(out)

    def squares(self, i: np.ndarray, j: np.ndarray):
        """Places and squared distances of pairs, by the two sizes they have."""
        sizes = self.sizes
        less = sizes[i] <= sizes[j]
        i, j = np.where(less, i, j), np.where(less, j, i)
        order = np.lexsort((sizes[j], sizes[i]))
        i, j = i[order], j[order]
        ends = np.flatnonzero(np.diff(sizes[i]) | np.diff(sizes[j])) + 1
        for lo, hi in zip([0, *ends], [*ends, len(i)]):
            if lo == hi:
                continue
            a, b = int(sizes[i[lo]]), int(sizes[j[lo]])
            steps = np.arange(a + 1) * a if a == b else np.union1d(np.arange(a + 1) * b, np.arange(1, b) * a)
            left, right, width = steps[:-1] // b, steps[:-1] // a, np.diff(steps) / (a * b)
            x, y, some = self.groups[a], self.groups[b], max(1, self.room // len(width))
            for k in range(lo, hi, some):
                to = slice(k, min(hi, k + some))
                gap = x[self.place[i[to]][:, None], left] - y[self.place[j[to]][:, None], right]
                gap *= gap
                yield order[to], (gap * width).sum(1)


class Bounds:
    """Lower bounds of squared distances, from block means."""

    def __init__(self, low: np.ndarray):
        self.low = low - low.mean(0)
        self.own = (self.low * self.low).sum(1)
        self.slack = 1e-12 * max(self.own.max(), 1e-300)

    def rows(self, at, to=slice(None)) -> np.ndarray:
        out = self.low[at] @ self.low[to].T
        out *= -2
        out += self.own[at][:, None]
        out += self.own[to]
        return out


def nearest(points, k: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of the ``k`` nearest points of each, itself among them, by distance and then number."""
    n = len(points)
    bounds, near, ordered = Bounds(points.low), np.empty((n, k), np.int32), np.empty((n, k))
    step, few = max(1, most // n), min(n, k)
    block = step * max(1, (most // 4) // (step * k))  # many pairs at a time, as some are taken by size
    for lo in range(0, n, block):
        parts = [np.arange(a, min(a + step, lo + block, n)) for a in range(lo, min(lo + block, n), step)]
        first = np.concatenate([np.argpartition(bounds.rows(p), few - 1, axis=1)[:, :few].astype(np.int32) if few < n else np.tile(np.arange(n, dtype=np.int32), (len(p), 1)) for p in parts])
        i = np.repeat(np.arange(lo, lo + len(first)), few)
        d = points.pairs(i, first.ravel())
        reach = d.reshape(first.shape).max(1)
        more_i, more_j, done = [], [], 0
        for p in parts:
            some = bounds.rows(p) <= (reach[p - lo] ** 2 * (1 + 1e-9) + bounds.slack)[:, None]
            np.put_along_axis(some, first[done : done + len(p)].astype(int), False, axis=1)
            a, b = np.nonzero(some)
            more_i.append(p[a])
            more_j.append(b)
            done += len(p)
        more_i, more_j = np.concatenate(more_i), np.concatenate(more_j)
        i, j, d = np.concatenate([i, more_i]), np.concatenate([first.ravel(), more_j]), np.concatenate([d, points.pairs(more_i, more_j)])
        order = np.lexsort((j, d, i))
        starts = np.searchsorted(i[order], np.arange(lo, lo + len(first)))
        take = order[starts[:, None] + np.arange(k)]
        near[lo : lo + len(first)], ordered[lo : lo + len(first)] = j[take], d[take]
    return near, ordered


def nearest_of(points, bounds: Bounds, i: int, others: np.ndarray) -> int:
    """The nearest of ``others`` to a point, ties to the first."""
    low = bounds.rows(np.array([i]), others)[0]
    top = points.pairs(np.array([i]), others[[np.argmin(low)]])[0]
    some = others[low <= top**2 * (1 + 1e-9) + bounds.slack]
    return int(some[np.argmin(points.pairs(np.full(len(some), i), some))])


def peaks_of(near: np.ndarray, ordered: np.ndarray, dim: float, most: int, z: float, growth: float, nearest_denser, rows: int = 4096) -> np.ndarray:
    """Labels by advanced density peaks, from each point's ``most`` nearest besides itself.

    ``nearest_denser(i, denser)`` finds the nearest of denser points, which come in
    order of density, where none is among the neighbours.
    """
    n = len(near)
    k_of, open_ = np.full(n, most), np.arange(n)
    for k in range(min(3, most), most):
        volume = dim * np.log(np.maximum(ordered[:, k], 1e-300))
        a, b = volume[open_], volume[near[open_, k + 1]]
        top = np.maximum(a, b)
        both = top + np.log(np.exp(a - top) + np.exp(b - top))
        stop = -2 * k * (a + b - 2 * both + np.log(4)) >= growth
        k_of[open_[stop]] = k
        open_ = open_[~stop]
    log_density = np.log(k_of) - dim * np.log(np.maximum(ordered[np.arange(n), k_of], 1e-300))
    error = np.sqrt((4 * k_of + 2) / np.maximum((k_of - 1) * k_of, 1))
    g = log_density - error
    down = np.argsort(-g, kind="stable")
    rank = np.empty(n, np.int32)
    rank[down] = np.arange(n)
    place, blocks = np.arange(near.shape[1]), range(0, n, rows)
    around = lambda lo: (place >= 1) & (place <= k_of[lo : lo + rows, None])
    top, covered = np.empty(n, bool), np.zeros(n, bool)
    parent = np.full(n, -1)
    for lo in blocks:
        here, own, inside = near[lo : lo + rows], rank[lo : lo + rows, None], around(lo)
        r = rank[here]
        top[lo : lo + rows] = (~inside | (r > own)).all(1)
        covered[here[inside & (r > own)]] = True  # a peak lies in no denser point's neighbourhood
        denser = r < own
        c = denser.argmax(1)
        d = ordered[lo : lo + rows]
        at = np.take_along_axis(d, c[:, None], 1)
        pick = np.where(denser & (d == at), r, n).argmin(1)
        known = denser.any(1) & ((at[:, 0] < d[:, -1]) | (near.shape[1] == n))
        parent[lo : lo + rows] = np.where(known, here[np.arange(len(here)), pick], -1)
    peaks = down[(top & ~covered)[down]]
    label = np.full(n, -1)
    label[peaks] = np.arange(len(peaks))
    for i in down:
        if label[i] < 0:
            label[i] = label[parent[i] if parent[i] >= 0 else nearest_denser(i, down[: rank[i]])]
    # borders: the densest point of one cluster whose neighbourhood meets the other
    saddle: dict = {}
    for lo in blocks:
        i, c = np.nonzero(around(lo))
        i += lo
        x, y = label[i], label[near[i, c]]
        meet = x != y
        i, x, y = i[meet], x[meet], y[meet]
        a, b = np.minimum(x, y), np.maximum(x, y)
        key = a * len(peaks) + b
        order = np.lexsort((i, -g[i], key))
        first = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
        for a, b, i in zip(a[first].tolist(), b[first].tolist(), i[first].tolist()):
            if saddle.get((a, b), (-np.inf,))[0] < g[i]:
                saddle[a, b] = (g[i], log_density[i], error[i])
    kept = merged(saddle, g[peaks], log_density[peaks], error[peaks], z)
    return np.unique(kept[label], return_inverse=True)[1]


def merged(saddle: dict, g: np.ndarray, log_density: np.ndarray, error: np.ndarray, z: float) -> np.ndarray:
    """The peak that each peak goes to: the highest border that isn't ``z`` errors below both its peaks is given up first."""

    def push(a, b, v):
        if min(log_density[c] - v[1] - z * (error[c] + v[2]) for c in (a, b)) < 0:
            heapq.heappush(heap, (-v[0], -min(a, b), -max(a, b)))

    links, heap, into = {c: {} for c in range(len(g))}, [], np.arange(len(g))
    for (a, b), v in saddle.items():
        links[a][b] = links[b][a] = v
        push(a, b, v)
    while heap:
        height, a, b = (-x for x in heapq.heappop(heap))
        v = links.get(a, {}).get(b)
        if v is None or v[0] != height:
            continue
        keep, gone = (a, b) if g[a] >= g[b] else (b, a)
        into[gone] = keep
        for other, v in links.pop(gone).items():
            del links[other][gone]
            if other != keep and links[keep].get(other, (-np.inf,))[0] < v[0]:
                links[keep][other] = links[other][keep] = v
                push(keep, other, v)
    while (into != into[into]).any():
        into = into[into]
    return into
