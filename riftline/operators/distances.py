"""Closed-form and kernel distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def laplace_w2(mu1, b1, mu2, b2):
    """W2 of two Laplace laws from their means and scales."""
    return F.sqrt((mu1 - mu2) * (mu1 - mu2) + 2 * (b1 - b2) * (b1 - b2))


def circle_distance(a, b) -> float:
    """W2 on the circle of length one of two samples of any sizes.

    The plans are the monotone ones up to a shift of the other's quantile
    function, and the squared cost is convex in the shift: bisection on its slope.
    """
    import numpy as np

    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    n, m = len(a), len(b)
    own = np.arange(n + 1) / n

    def pieces(shift):
        """Widths of the joint steps and the gap of the quantiles on each."""
        steps = np.unique(np.concatenate([own, np.mod(np.arange(m) / m + shift, 1.0)]))
        mid = (steps[1:] + steps[:-1]) / 2
        turn, level = np.divmod(mid - shift, 1.0)
        return np.diff(steps), a[np.minimum((mid * n).astype(int), n - 1)] - b[np.minimum((level * m).astype(int), m - 1)] - turn

    def cost(shift):
        width, gap = pieces(shift)
        return float((width * gap * gap).sum())

    low, high = -1.5, 1.5
    while high - low > 1e-9:
        mid, h = (low + high) / 2, 1e-10
        low, high = (mid, high) if cost(mid + h) < cost(mid - h) else (low, mid)
    return min(cost(s) for s in (low, (low + high) / 2, high)) ** 0.5


def circle_distances(samples: DataFrame) -> DataFrame:
    """series_id, q, i, j, d of segments' values in [0, 1)."""
    from .segments import pairs

    rows = pairs(samples)
    kind = samples.schema["series_id"].dataType.simpleString()

    def kernel(batches):
        for pdf in batches:
            pdf["d"] = [circle_distance(a, b) for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf[["series_id", "q", "i", "j", "d"]]

    return rows.mapInPandas(kernel, f"series_id {kind}, q double, i long, j long, d double")


def principal_axes(rows: DataFrame, columns: list[str]) -> list[tuple[float, list[float]]]:
    """Eigenvalues, descending, and vectors of the sample covariance; each vector's largest entry is positive.

    Only the covariances, a number for each pair of columns, reach the driver.
    """
    import numpy as np

    cells = [F.covar_samp(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    flat = rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first()
    cov, k = np.zeros((len(columns),) * 2), 0
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            cov[i, j] = cov[j, i] = flat[k]
            k += 1
    values, vectors = np.linalg.eigh(cov)
    out = []
    for k in np.argsort(-values):
        v = vectors[:, k]
        out.append((float(values[k]), (v * np.sign(v[np.argmax(np.abs(v))])).tolist()))
    return out


def project(rows: DataFrame, columns: list[str], prefix: str = "pc") -> DataFrame:
    """Uncentred projections on the principal axes, as columns ``prefix1``, ``prefix2`` ..."""
    axes = principal_axes(rows, columns)
    return rows.withColumns({f"{prefix}{k + 1}": sum((F.col(c) * F.lit(v) for c, v in zip(columns[1:], axis[1:])), F.col(columns[0]) * F.lit(axis[0])) for k, (_, axis) in enumerate(axes)})
