"""Density peaks from nearest neighbours, against the matrix of all pairs."""

import numpy as np
import pytest

from riftline.functions import arrays
from riftline.operators import clustering, neighbours


def uneven(count, copies=0):
    rng = np.random.default_rng(2)
    v = [np.sort(np.round(rng.normal(8 * (k % 4), 1 + k % 2, 1 + int(rng.integers(30))), 2)) for k in range(count)]
    return v + v[:copies] + [np.repeat(x, 2) for x in v[:copies]]


def test_profiles_equal_those_of_the_engine(spark):
    v = uneven(40)
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "k long, v array<double>")
    want = [r.p for r in rows.orderBy("k").select(arrays.quantile_profile(rows["v"], 32).alias("p")).collect()]
    assert (neighbours.quantile_profiles(v, 32) == np.array(want)).all()


@pytest.mark.parametrize("exact", [False, True])
def test_peaks_by_blocks_equal_those_of_the_matrix(monkeypatch, exact):
    v = uneven(500, 0 if exact else 60)
    matrix = clustering.sample_matrix(v) if exact else clustering.profile_matrix(neighbours.quantile_profiles(v, 64))
    want, kept = clustering.density_labels(matrix)
    monkeypatch.setattr(neighbours.nearest, "__defaults__", (5000,))  # blocks of ten rows
    points, which = clustering.distinct_points(v, exact, 64)
    got, found = clustering.point_peaks(points)
    assert found == kept and (got[which] == want).all() and len(set(want)) > 2


def test_neighbours_are_exact_and_in_order():
    points = neighbours.Samples(uneven(200))
    d = clustering.sample_matrix(points.v)
    near, ordered = neighbours.nearest(points, 21, 3000)
    assert (near == np.argsort(d, axis=1, kind="stable")[:, :21]).mean() > 0.99  # but for ties by rounding
    assert ordered == pytest.approx(np.sort(d, axis=1)[:, :21], abs=1e-12)


@pytest.mark.parametrize("by", ["profile", "sample"])
def test_many_segments_make_no_matrix(monkeypatch, by):
    def whole(*_):
        raise AssertionError("a matrix of all pairs")

    for name in ("profile_matrix", "sample_matrix"):
        monkeypatch.setattr(clustering, name, whole)
    v = uneven(2000, 100)
    label, status = clustering.labels_by_profile(v, "adp", 3, 0.5, 1.65, 32) if by == "profile" else clustering.labels_by_sample(v, "adp", 3, 0.5, 1.65)
    assert status == "ok" and len(label) == len(v) and (label[2000:2100] == label[:100]).all()


def test_few_distinct_laws_among_many_segments_say_so():
    v = [np.array([1.0, 2.0]), np.array([3.0])] * 1500
    assert clustering.labels_by_profile(v, "adp", 3, 0.5, 1.65, 16) == ([None] * 3000, "2 distinct segments")


def test_changes_are_clustered_from_samples(spark, monkeypatch):
    from riftline.operators import pipelines, segments

    def profiles(*_):
        raise AssertionError("profiles as rows")

    monkeypatch.setattr(segments, "profiles", profiles)
    series = spark.createDataFrame([("a", t, float(t // 20 % 3 * 9 + t % 5), 400) for t in range(400)], "series_id string, t long, x double, n long")
    points = spark.createDataFrame([("a", 0.0, t) for t in range(0, 401, 20)], "series_id string, q double, t long")
    rows = pipelines.cluster_changes(series, points, append_end=False).collect()
    assert len(rows) == 20 and {r.status for r in rows} == {"3 distinct segments"}


@pytest.mark.parametrize("sigma", [0.5, 20.0, 500.0])
@pytest.mark.parametrize("dense", [0, 4096])
@pytest.mark.parametrize("whole", [10, 512])
def test_equal_segments_count_in_spectra(monkeypatch, sigma, dense, whole):
    v = uneven(230)
    v += v[:80] + v[:40]
    d = clustering.profile_matrix(neighbours.quantile_profiles(v, 32))
    want = np.linalg.eigvalsh(clustering.laplacian(clustering.gaussian(d, sigma)))[:11]
    monkeypatch.setattr(clustering, "DENSE", dense)
    monkeypatch.setattr(clustering, "WHOLE", whole if dense else 10)
    spectrum = clustering.WeightedSpectrum(*clustering.distinct_points(v, False, 32))
    values, vectors = clustering.lowest(spectrum.similarity(sigma), 11, weight=spectrum.weight)
    assert values == pytest.approx(want, abs=1e-8)
    full = (vectors / np.sqrt(spectrum.weight)[:, None])[spectrum.which]
    lap = clustering.laplacian(clustering.gaussian(d, sigma))
    assert np.abs(lap @ full - full * values).max() < 1e-7 and full.T @ full == pytest.approx(np.eye(11), abs=1e-8)


def test_many_segments_have_spectra_of_their_distinct_profiles(monkeypatch):
    v = uneven(300) * 8
    sizes = []
    product = clustering.product_matrix
    for name in ("profile_matrix", "product_matrix"):
        monkeypatch.setattr(clustering, name, lambda x: (sizes.append(len(x)), product(x))[1])
    label, status = clustering.labels_by_profile(v, "spectral", 3, 0.5, 1.65, 32)
    found = clustering.sweep_of(v, [0.5, 40.0], 3, 32)
    assert status == "ok" and (label.reshape(8, 300) == label[:300]).all() and max(sizes) <= 300 and len(found) == 2


def test_grid_works_on_few_windows_at_once(spark, monkeypatch):
    import threading
    import time

    from riftline.operators import model

    now, most, lock = [0], [0], threading.Lock()

    def statistic(self, series, dim, w):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        return series

    def finished(rows, label):
        with lock:
            now[0] -= 1
        return rows

    monkeypatch.setattr(model.SegmentClusterer, "_statistic", statistic)
    monkeypatch.setattr(model.SegmentClusterer, "_labels", lambda self, series, dim, stat, levels: [None, None, stat])
    monkeypatch.setattr(model, "staged", finished)
    rows = spark.createDataFrame([("a", 0, 0.5, t, t // 3 % 2) for t in range(20)], "series_id string, dim int, q double, t long, label long")
    assert model.SegmentClusterer().grid_scores(rows, [0], list(range(6)), [0.5], 2).count() == 6
    assert most[0] <= 2
