"""Clustering of segments by their distance matrices, and of values.

A distance matrix of one series' segments is a task's input: its order is the
number of segments, not of points. Kernels are NumPy; their labels come back as
rows (series_id, q, seg, label).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import neighbours as N

#: Likelihood-ratio bound at which a neighbourhood stops growing: chi-square with one degree of freedom at 1e-6.
GROWTH = 23.928
LEAST_DISTINCT = 5


def collapse(d: np.ndarray, digits: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(representatives in first-occurrence order, representative of each) of rows equal to ``digits`` places."""
    seen, first, which = {}, [], np.empty(len(d), int)
    for i, row in enumerate(d):  # by row: no copy of the matrix
        which[i] = seen.setdefault(hashlib.sha256((np.round(row, digits) + 0.0).tobytes()).digest(), len(first))
        if which[i] == len(first):
            first.append(i)
    return np.array(first, int), which


def intrinsic_dimension(ordered: np.ndarray) -> float:
    """Two-nearest-neighbour estimate from sorted distances (self first), the top tenth of ratios left out."""
    r1, r2 = ordered[:, 1], ordered[:, 2]
    ratio = np.sort((r2 / r1)[r1 > 0])
    ratio = ratio[: max(1, int(0.9 * len(ratio)))]
    total = np.log(ratio[ratio > 0]).sum()
    return max(1.0, float(len(ratio) / total)) if total > 0 else 1.0


def density_peaks(d: np.ndarray, z: float = 1.65, most: int | None = None) -> np.ndarray:
    """Advanced density peaks: labels from adaptive-neighbourhood densities and peaks merged within ``z`` errors.

    A neighbourhood grows until its likelihood test stops it, to ``most`` points
    at most. The published rule has no bound (``most=len(d)``); by default it is
    twice the root of the number of points, as beyond the smaller clusters' sizes
    equal densities say nothing and small groups merge.
    """
    n = len(d)
    most = min(n - 1, max(3, int(2 * n**0.5)) if most is None else most)
    near = np.argsort(d, axis=1, kind="stable")[:, : max(most + 1, 3)].astype(np.int32)
    ordered = np.take_along_axis(d, near, 1)
    farther = lambda i, denser: denser[np.argmin(d[i, denser])]
    return N.peaks_of(near[:, : most + 1], ordered[:, : most + 1], intrinsic_dimension(ordered), most, z, GROWTH, farther)


def point_peaks(points, z: float = 1.65) -> tuple[np.ndarray, int]:
    """``density_labels`` of points that find their own neighbours: no matrix of all pairs is made."""
    which = np.arange(len(points))
    while True:
        n = len(points)
        if n < LEAST_DISTINCT:
            raise ValueError(f"{n} distinct segments")
        most = min(n - 1, max(3, int(2 * n**0.5)))
        near, ordered = N.nearest(points, most + 1)
        i, c = np.nonzero(ordered < N.EQUAL)
        j = near[i, c]
        i, j = i[i != j], j[i != j]
        if not len(i):
            break
        into = np.arange(n)
        np.minimum.at(into, i, j)
        while (into != into[into]).any():
            into = into[into]
        kept, place = np.unique(into, return_inverse=True)
        points, which = points.take(kept), place[which]
    bounds = N.Bounds(points.low)
    farther = lambda i, denser: N.nearest_of(points, bounds, i, denser)
    return N.peaks_of(near, ordered, intrinsic_dimension(ordered), most, z, GROWTH, farther)[which], n


def density_labels(d: np.ndarray, z: float = 1.65) -> tuple[np.ndarray, int]:
    """(labels, distinct segments); too few distinct segments raise ``ValueError``."""
    kept, which = collapse(d)
    if len(kept) < LEAST_DISTINCT:
        raise ValueError(f"{len(kept)} distinct segments")
    return density_peaks(d if len(kept) == len(d) else d[np.ix_(kept, kept)], z)[which], len(kept)


def k_means(x: np.ndarray, k: int, seed: int = 0, tries: int = 10, rounds: int = 100) -> np.ndarray:
    rng, best, out = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(tries):
        centres = x[rng.choice(len(x), 1)]
        while len(centres) < k:
            gap = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() else rng.integers(len(x))]])
        for _ in range(rounds):
            label = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = ((x - centres[label]) ** 2).sum()
        if cost < best:
            best, out = cost, label
    return out


def laplacian(similarity: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    if weight is not None:  # points that stand for ``weight`` equal ones
        root = np.sqrt(weight / np.maximum(similarity @ weight, 1e-300))
        return np.eye(len(similarity)) - similarity * root[:, None] * root
    degree = np.maximum(similarity.sum(1), 1e-300)
    return np.eye(len(similarity)) - similarity / np.sqrt(degree[:, None] * degree[None, :])


#: Points up to which all eigenpairs are found; above, only the lowest.
WHOLE = 512


def components(similarity: np.ndarray, least: float) -> list[np.ndarray]:
    """Members of the parts that similarities above ``least`` connect, the largest first, ties by the first member."""
    label, count = np.full(len(similarity), -1), 0
    for i in range(len(similarity)):
        if label[i] >= 0:
            continue
        label[i], todo = count, [i]
        while todo:
            near = np.flatnonzero((similarity[todo.pop()] > least) & (label < 0))
            label[near] = count
            todo.extend(near.tolist())
        count += 1
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(label, minlength=count))[:-1])
    return sorted(parts, key=lambda p: (-len(p), p[0]))


def lowest(similarity, m: int, tolerance: float = 1e-9, restarts: int = 24, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` lowest eigenvalues of the Laplacian, with vectors.

    ``weight``: how many equal points each stands for. The Laplacian of them all has
    these eigenvalues and ones (their similarities have no negative eigenvalue); its
    vectors are the ones found here over the root of the weight.

    Similarities that rounding would lose against the degrees don't connect, so
    every part they leave has an exact vector of eigenvalue 0; if these are more
    than asked for, those of the largest parts are taken. The others come from
    block Krylov spaces without these vectors, restarted until the residuals are
    below ``tolerance``; what doesn't get there is decomposed as a whole.
    """
    n, one = len(similarity), weight is None
    if n <= WHOLE and one:
        values, vectors = np.linalg.eigh(laplacian(similarity))
        return values[:m], vectors[:, :m]
    degree = np.maximum(similarity.sum(1) if one else similarity @ weight, 1e-300)
    weight = np.ones(n) if one else weight
    if not np.isfinite(degree).all():
        raise np.linalg.LinAlgError("Eigenvalues did not converge")
    parts = components(similarity, 2.0**-53 / (n if one else weight.sum()))
    if not one:
        parts = sorted(parts, key=lambda p: (-weight[p].sum(), p[0]))
    mass = np.sqrt(degree if one else weight * degree)
    null = np.zeros((n, min(m, len(parts))))
    for c in range(null.shape[1]):
        null[parts[c], c] = mass[parts[c]]
    null /= np.linalg.norm(null, axis=0)
    more = m - null.shape[1]
    if not more:
        return np.zeros(m), null
    if n <= WHOLE:
        values, vectors = np.linalg.eigh(laplacian(similarity, weight) + 2 * null @ null.T)  # the exact vectors of 0 go to the end
        lost = max(0, m - n)  # fewer points than asked for: what is left are ones
        more = min(more, n - null.shape[1])
        return np.concatenate([np.zeros(null.shape[1]), np.maximum(values[:more], 0), np.ones(lost)]), np.hstack([null, vectors[:, :more], np.zeros((n, lost))])
    root = (1 / np.sqrt(degree) if one else np.sqrt(weight / degree))[:, None]
    rest = lambda x: root * (similarity @ (root * x))  # noqa: E731  the scaled similarities: one less their eigenvalues is the Laplacian's
    for weak in (1e-1, 1e-2, 1e-3, 1e-4, 1e-6, 1e-8, 1e-10, 1e-12, 1e-14):
        parts = components(similarity, weak)
        if len(parts) <= 120:
            break
    else:
        parts = []
    x = np.random.default_rng(0).normal(size=(n, max(more + 12, len(parts) + 8)))
    for c, part in enumerate(parts):
        x[:, c] = 0
        x[part, c] = mass[part]
    x = rest(x - null @ (null.T @ x))
    width = x.shape[1]
    for _ in range(restarts):
        basis, image = null, []
        for _ in range(max(3, 184 // width)):
            for _ in range(2):
                x = np.linalg.qr(x - basis @ (basis.T @ x))[0]
            basis = np.hstack([basis, x])
            image.append(rest(x))
            x = image[-1]
        own, image = basis[:, null.shape[1] :], np.hstack(image)
        inner = own.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, ::-1][:, :width]
        values, x = values[::-1][:width], own @ turn
        miss = np.linalg.norm((image @ turn - x * values)[:, :more], axis=0).max()
        if miss < tolerance:
            return np.concatenate([np.zeros(null.shape[1]), np.maximum(1 - values[:more], 0)]), np.hstack([null, x[:, :more]])
    if isinstance(similarity, Sparse):
        raise np.linalg.LinAlgError("Eigenvalues did not converge")
    values, vectors = np.linalg.eigh(laplacian(similarity, None if one else weight))
    return values[:m], vectors[:, :m]


class Sparse:
    """Gaussian similarities of points that rounding would not lose against the degrees, by rows."""

    def __init__(self, points, sigma: float, total: int, most: int = 1 << 22):
        n, bounds = len(points), N.Bounds(points.low)
        reach = 2 * sigma * (53 * np.log(2) + np.log(total))
        step, cols, values, sizes = max(1, most // n), [], [], []
        for lo in range(0, n, step):
            at = np.arange(lo, min(lo + step, n))
            i, j = np.nonzero(bounds.rows(at) <= reach * (1 + 1e-9) + bounds.slack)
            d = points.pairs(i + lo, j)
            keep = (d * d <= reach) | (i + lo == j)
            cols.append(j[keep].astype(np.int32))
            values.append(np.exp(d[keep] ** 2 / (-2 * sigma)))
            sizes.append(np.bincount(i[keep], minlength=len(at)))
        self.cols, self.values = np.concatenate(cols), np.concatenate(values)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def __len__(self):
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        row, own = np.zeros(len(self)), slice(self.starts[i], self.starts[i + 1])
        row[self.cols[own]] = self.values[own]
        return row

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out, flat = np.empty((len(self), *x.shape[1:])), x.reshape(len(x), -1)
        lo = 0
        while lo < len(self):  # a million products at a time; every row has its own point
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + (1 << 20) // flat.shape[1], side="right")) - 1)
            own = slice(self.starts[lo], self.starts[hi])
            part = np.add.reduceat(self.values[own, None] * flat[self.cols[own]], self.starts[lo:hi] - self.starts[lo], axis=0)
            out[lo:hi] = part.reshape(hi - lo, *x.shape[1:])
            lo = hi
        return out


#: Distinct points up to which similarities are a matrix; of more, those that count are kept.
DENSE = 4096


class WeightedSpectrum:
    """Spectral clusterings of many segments through their distinct laws."""

    def __init__(self, points, which: np.ndarray):
        self.points, self.which, self.weight = points, which, np.bincount(which).astype(float)
        self.d = product_matrix(points.v) if len(points) <= DENSE else None

    def similarity(self, sigma: float):
        return Sparse(self.points, sigma, len(self.which)) if self.d is None else gaussian(self.d, sigma)

    def labels(self, vectors: np.ndarray, similarity, k: int) -> np.ndarray:
        mass = np.sqrt(self.weight * np.maximum(similarity @ self.weight, 1e-300))
        return k_means((vectors[:, :k] / mass[:, None])[self.which], k)

    def spectral_labels(self, sigma: float, k: int) -> np.ndarray:
        similarity = self.similarity(sigma)
        return self.labels(lowest(similarity, k, weight=self.weight)[1], similarity, k)

    def sweep_point(self, sigma: float, k: int, most: int = 10) -> tuple[int, int]:
        similarity = self.similarity(sigma)
        values, vectors = lowest(similarity, max(most + 1, k), weight=self.weight)
        return widest_gap(values[: most + 1]), len(np.unique(self.labels(vectors, similarity, k)))


def labels_of(vectors: np.ndarray, similarity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    degree = np.maximum(similarity.sum(1), 1e-300)
    return k_means(vectors[:, :k] / np.sqrt(degree)[:, None], k, seed)


def spectral_labels(similarity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    return labels_of(lowest(similarity, k)[1], similarity, k, seed)


def widest_gap(values: np.ndarray) -> int:
    return int(np.argmax(np.diff(values))) + 1 if len(values) > 1 else 1


def eigengap(similarity: np.ndarray, most: int = 10) -> int:
    return widest_gap(np.linalg.eigvalsh(laplacian(similarity))[: most + 1] if len(similarity) <= WHOLE else lowest(similarity, most + 1)[0])


def sweep_point(similarity: np.ndarray, clusters: int, most: int = 10) -> tuple[int, int | None]:
    """(``eigengap``, labels that ``spectral_labels`` uses), from one search for eigenpairs where it isn't a decomposition."""
    if len(similarity) <= max(WHOLE, clusters):
        return eigengap(similarity, most), len(np.unique(spectral_labels(similarity, clusters))) if len(similarity) >= clusters else None
    values, vectors = lowest(similarity, max(most + 1, clusters))
    return widest_gap(values[: most + 1]), len(np.unique(labels_of(vectors, similarity, clusters)))


def gaussian(d: np.ndarray, sigma: float) -> np.ndarray:
    """Similarities of distances, in one new matrix."""
    a = d * d
    a /= -2 * sigma
    return np.exp(a, out=a)


METHODS = ("adp", "spectral")


def square(i, j, d) -> np.ndarray:
    out = np.zeros((max(i.max(), j.max()) + 1,) * 2)
    out[i, j] = out[j, i] = d
    return out


def profile_matrix(v: np.ndarray) -> np.ndarray:
    """W2 of all pairs of profiles, one to a row."""
    out = np.zeros((len(v), len(v)))
    for i in range(len(v) - 1):
        for lo in range(i + 1, len(v), 64):  # what stays in a core's cache
            gap = v[lo : lo + 64] - v[i]
            out[i, lo : lo + 64] = np.sqrt(np.einsum("ij,ij->i", gap, gap) / v.shape[1])
        out[i + 1 :, i] = out[i, i + 1 :]
    return out


def sample_matrix(v: list[np.ndarray], room: int = 1 << 15) -> np.ndarray:
    """W2 of all pairs of sorted samples of any sizes, as ``segments.exact_w2``: samples of one size meet those of another in one array."""
    sizes = np.array([len(x) for x in v])
    out = np.full((len(v), len(v)), np.nan)
    np.fill_diagonal(out, 0.0)
    groups = [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes) if n]
    groups = [(n, at, np.stack([v[i] for i in at]).astype(float)) for n, at in groups]
    for k, (n, at, x) in enumerate(groups):
        for m, to, y in groups[k:]:
            if n == m:
                a, b, width = x, y, None
            else:
                steps = np.union1d(np.arange(n + 1) * m, np.arange(1, m) * n)
                a, b, width = x[:, steps[:-1] // m], y[:, steps[:-1] // n], np.diff(steps).astype(float)
            rows = max(1, room // a.shape[1])
            some = min(len(a), max(1, rows // len(b)))
            for i in range(0, len(a), some):
                for j in range(i if n == m else 0, len(b), rows):
                    gap = b[None, j : j + rows] - a[i : i + some, None]
                    gap *= gap
                    if width is not None:
                        gap *= width
                    d = np.sqrt(gap.sum(-1) / (n if width is None else n * m))
                    out[at[i : i + some, None], to[None, j : j + rows]] = d
                    out[to[j : j + rows, None], at[None, i : i + some]] = d.T
    return out


def product_matrix(v: np.ndarray, near: float = 1e-4) -> np.ndarray:
    """``profile_matrix`` to some 1e-11 by one matrix product; pairs so near that it would lose digits are subtracted."""
    x = v - v.mean(0)
    own = (x * x).sum(1)
    out = x @ x.T
    out *= -2
    out += own[:, None]
    out += own
    for i in range(len(v)):
        at = np.flatnonzero(out[i] <= near * (own[i] + own))
        gap = v[at] - v[i]
        out[i, at] = (gap * gap).sum(1)
    out /= v.shape[1]
    return np.sqrt(out, out=out)


def sample_similarity(v: list[np.ndarray], sigma: float, blocks: int = 16, room: int = 1 << 15) -> np.ndarray:
    """``gaussian`` of ``sample_matrix``. Of many samples, pairs whose similarity rounding would lose against the degrees are 0.

    Means over blocks of levels are never further apart than the samples, so they tell most of these pairs without the samples.
    """
    n = len(v)
    if n <= WHOLE or not all(len(x) and np.isfinite(x).all() for x in v):
        return gaussian(sample_matrix(v), sigma)
    most = 2 * sigma * (53 * np.log(2) + np.log(n))
    p = np.stack([N.block_means(x, blocks) for x in v])
    p -= p.mean(0)
    own = (p * p).sum(1)
    i, j = [], []
    for lo in range(0, n, 256):
        gap = own[lo : lo + 256, None] + own - 2 * p[lo : lo + 256] @ p.T
        a, b = np.nonzero(gap <= (most * blocks + 1e-9 * (own[lo : lo + 256, None] + own)) * (1 + 1e-9))
        keep = b > a + lo
        i.append((a[keep] + lo).astype(np.int32))
        j.append(b[keep].astype(np.int32))
    i, j = np.concatenate(i), np.concatenate(j)
    sizes = np.array([len(x) for x in v])
    i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
    order = np.lexsort((sizes[j], sizes[i]))
    i, j = i[order], j[order]
    out = np.eye(n)
    groups, place = {}, np.empty(n, int)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        groups[int(size)], place[at] = np.stack([v[k] for k in at]).astype(float), np.arange(len(at))
    ends = np.flatnonzero(np.diff(sizes[i]) | np.diff(sizes[j])) + 1
    for lo, hi in zip([0, *ends], [*ends, len(i)]):
        if lo == hi:
            continue
        a, b = int(sizes[i[lo]]), int(sizes[j[lo]])
        steps = np.arange(a + 1) * a if a == b else np.union1d(np.arange(a + 1) * b, np.arange(1, b) * a)
        left, right, width = steps[:-1] // b, steps[:-1] // a, np.diff(steps) / (a * b)
        x, y, some = groups[a], groups[b], max(1, room // len(width))
        for k in range(lo, hi, some):
            one, two = i[k : min(hi, k + some)], j[k : min(hi, k + some)]
            gap = x[place[one][:, None], left] - y[place[two][:, None], right]
            gap *= gap
            out[one, two] = out[two, one] = np.exp((gap * width).sum(1) / (-2 * sigma))
    return out


def matrix_labels(d: np.ndarray, method: str, clusters: int, sigma: float, z: float):
    """(label of each segment, or None, and why)."""
    try:
        if method == "adp":
            return density_labels(d, z)[0], "ok"
        if len(d) < clusters:
            return [None] * len(d), f"{len(d)} segments"
        return spectral_labels(gaussian(d, sigma), clusters), "ok"
    except ValueError as e:
        return [None] * len(d), str(e)


#: Segments up to which adaptive density peaks take the matrix of all pairs; more find their neighbours by blocks.
MATRIX = 2048


def finite(v: list[np.ndarray]) -> bool:
    return all(len(x) and np.isfinite(x).all() for x in v)


def distinct_points(v: list[np.ndarray], exact: bool, levels: int | None = None):
    """(points, point of each segment): one point for all segments of one law, or of one profile."""
    first, which = N.distinct(N.sample_law(x) if exact else x.tobytes() for x in v)
    v = [v[i] for i in first]
    if exact:
        return N.Samples(v), which
    x = np.stack(v).astype(float) if levels is None else N.quantile_profiles(v, levels)
    first, again = N.distinct(row.tobytes() for row in x)
    return N.Profiles(x if len(first) == len(x) else x[first]), again[which]


def profile_labels(rows: DataFrame, method: str = "adp", clusters: int = 3, sigma: float = 0.5, z: float = 1.65, levels: int | None = None) -> DataFrame:
    """``segment_labels`` from series_id, q, seg, v: pairs of segments are made in the task that clusters them, and are never rows.

    ``v`` is a profile, or with ``levels`` a sorted sample whose profile of so many levels is made in the task.
    """

    return _labels_in_task(rows, lambda v: labels_by_profile(v, method, clusters, sigma, z, levels), method)


def labels_by_profile(v: list[np.ndarray], method: str, clusters: int, sigma: float, z: float, levels: int | None = None):
    if method == "adp" and len(v) > MATRIX and finite(v):
        return peak_labels(*distinct_points(v, False, levels), z)
    if len(v) > max(MATRIX, clusters) and finite(v):
        return WeightedSpectrum(*distinct_points(v, False, levels)).spectral_labels(sigma, clusters), "ok"
    x = np.stack(v).astype(float) if levels is None else N.quantile_profiles(v, levels)
    return matrix_labels(profile_matrix(x), method, clusters, sigma, z)


def peak_labels(points, which: np.ndarray, z: float):
    try:
        return point_peaks(points, z)[0][which], "ok"
    except ValueError as e:
        return [None] * len(which), str(e)


def sample_labels(samples: DataFrame, method: str = "adp", clusters: int = 3, sigma: float = 0.5, z: float = 1.65) -> DataFrame:
    """The same from whole sorted samples ``v``, by exact distances."""
    return _labels_in_task(samples, lambda v: labels_by_sample(v, method, clusters, sigma, z), method)


def labels_by_sample(v: list[np.ndarray], method: str, clusters: int, sigma: float, z: float):
    if method == "adp" and len(v) > MATRIX and finite(v):
        return peak_labels(*distinct_points(v, True), z)
    if method == "adp" or len(v) < clusters:
        return matrix_labels(sample_matrix(v), method, clusters, sigma, z)
    try:
        return spectral_labels(sample_similarity(v, sigma), clusters), "ok"
    except ValueError as e:
        return [None] * len(v), str(e)


def _labels_in_task(rows: DataFrame, labels, method: str) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    kind = rows.schema["series_id"].dataType.simpleString()

    def kernel(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seg")
        label, status = labels(pdf["v"].to_list())
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "q": pdf["q"].iloc[0], "seg": pdf["seg"].to_numpy(), "label": pd.array(label, dtype="Int64"), "status": status})

    # few rows with much work: left to their size, all series would share a task
    return rows.repartition(64, "series_id", "q").groupBy("series_id", "q").applyInPandas(kernel, f"series_id {kind}, q double, seg long, label long, status string")


def segment_labels(distances: DataFrame, method: str = "adp", clusters: int = 3, sigma: float = 0.5, z: float = 1.65) -> DataFrame:
    """series_id, q, seg, label, status of every segment; a series that can't be clustered has null labels and says why."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    kind = distances.schema["series_id"].dataType.simpleString()

    def kernel(pdf):
        import pandas as pd

        d = square(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["d"].to_numpy())
        label, status = matrix_labels(d, method, clusters, sigma, z)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "q": pdf["q"].iloc[0], "seg": np.arange(len(d)), "label": pd.array(label, dtype="Int64"), "status": status})

    return distances.groupBy("series_id", "q").applyInPandas(kernel, f"series_id {kind}, q double, seg long, label long, status string")


#: The bandwidths of the sweep, a quarter of a decade apart from 0.001 to 1000, and the code's 1/2.
SIGMAS = sorted({0.5, *(round(10 ** (k / 4 - 3), 6) for k in range(25))})


SWEEP = "q double, sigma double, eigengap_k int, n_used int"


def sigma_sweep(distances: DataFrame, sigmas: list[float], clusters: int = 3) -> DataFrame:
    """series_id, q, sigma, eigengap_k, n_used of spectral clusterings over bandwidths; each sigma is its own task."""
    grid = distances.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    kind = distances.schema["series_id"].dataType.simpleString()

    def kernel(pdf):
        d = square(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["d"].to_numpy())
        gap, used = sweep_point(gaussian(d, pdf["sigma"].iloc[0]), clusters)
        return pdf.iloc[:1][["series_id", "q", "sigma"]].assign(eigengap_k=gap, n_used=used)

    return grid.groupBy("series_id", "q", "sigma").applyInPandas(kernel, f"series_id {kind}, {SWEEP}")


def profile_sigma_sweep(rows: DataFrame, sigmas: list[float], clusters: int = 3, tasks: int = 13, levels: int | None = None) -> DataFrame:
    """``sigma_sweep`` from series_id, q, seg, v: a series goes to ``tasks`` tasks, each with its share of the sigmas, which make the pairs themselves.

    ``v`` is a profile, or with ``levels`` a sorted sample whose profile of so many levels is made in the task.
    """
    kind = rows.schema["series_id"].dataType.simpleString()
    tasks = min(tasks, len(sigmas))
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartition(64, "series_id", "q", "_part")

    def kernel(pdf):
        import pandas as pd

        own = [float(s) for s in sigmas[int(pdf["_part"].iloc[0]) :: tasks]]
        found = sweep_of(pdf.sort_values("seg")["v"].to_list(), own, clusters, levels)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "q": pdf["q"].iloc[0], "sigma": own, "eigengap_k": [g for g, _ in found], "n_used": pd.array([u for _, u in found], dtype="Int64")})

    return parts.groupBy("series_id", "q", "_part").applyInPandas(kernel, f"series_id {kind}, {SWEEP}")


def sweep_of(v: list[np.ndarray], sigmas: list[float], clusters: int, levels: int | None = None) -> list[tuple[int, int | None]]:
    if len(v) > max(MATRIX, clusters) and finite(v):
        spectrum = WeightedSpectrum(*distinct_points(v, False, levels))
        return [spectrum.sweep_point(s, clusters) for s in sigmas]
    x = np.stack(v).astype(float) if levels is None else N.quantile_profiles(v, levels)
    d = profile_matrix(x) if len(x) <= WHOLE else product_matrix(x)
    return [sweep_point(gaussian(d, s), clusters) for s in sigmas]


def value_clusters(rows: DataFrame, k: int, column: str = "x", tries: int = 10, seed: int = 0) -> DataFrame:
    """``rows`` with ``label``: distributed k-means on values, the best of several seeds by cost. ``k`` is at most the rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    k = max(1, min(k, rows.count()))
    rows = staged(rows, "values")
    data = VectorAssembler(inputCols=[column], outputCol="_f").transform(rows)
    models = [KMeans(k=max(k, 2), seed=seed + s, featuresCol="_f", predictionCol="label").fit(data) for s in range(tries if k > 1 else 0)]
    if not models:
        return rows.withColumn("label", F.lit(0))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("_f")
