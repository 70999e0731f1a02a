"""Distances, clustering and Markov scores against brute force and known structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators import clustering, distances, msm, reports, scoring, segments
from riftline.operators.model import SegmentClusterer


def samples(spark, *vectors):
    return spark.createDataFrame([("a", 0.0, k, sorted(map(float, v))) for k, v in enumerate(vectors)], "series_id string, q double, seg long, v array<double>")


def test_exact_w2_of_unequal_sizes(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=6), rng.normal(1, 2, size=9)
    rows = segments.pairs(samples(spark, a, b)).select("i", "j", segments.exact_w2(F.col("a"), F.col("b")).alias("d")).collect()
    d = {(r.i, r.j): r.d for r in rows}
    want = np.sqrt(((np.sort(np.repeat(a, 3)) - np.sort(np.repeat(b, 2))) ** 2).mean())
    assert d[0, 1] == pytest.approx(want) and d[0, 0] == d[1, 1] == 0


def test_circle_distance_is_translation_invariant():
    rng = np.random.default_rng(5)
    a, b = rng.random(7), rng.random(5)
    base = distances.circle_distance(a, b)
    assert distances.circle_distance((a + 0.4) % 1, (b + 0.4) % 1) == pytest.approx(base, abs=1e-6)
    assert distances.circle_distance(a, a) == pytest.approx(0, abs=1e-7)
    assert distances.circle_distance([0.02], [0.98]) == pytest.approx(0.04, abs=1e-7)


def groups(rng, sizes=(20, 20, 20)):
    x = np.concatenate([rng.normal(10 * k, 0.5, (n, 1)) for k, n in enumerate(sizes)])
    return np.abs(x - x.T), np.repeat(np.arange(len(sizes)), sizes)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_density_peaks_find_groups():
    d, truth = groups(np.random.default_rng(0))
    labels, distinct = clustering.density_labels(d)
    assert same_partition(labels, truth) and distinct == 60


def test_density_peaks_need_distinct_segments():
    with pytest.raises(ValueError):
        clustering.density_labels(np.zeros((8, 8)))


def test_spectral_and_eigengap_find_groups():
    d, truth = groups(np.random.default_rng(1))
    a = np.exp(-d * d)
    assert same_partition(clustering.spectral_labels(a, 3), truth)
    assert clustering.eigengap(np.exp(-d * d / 20)) == 3


def test_vamp_forms_agree():
    c = np.random.default_rng(7).integers(1, 50, (4, 4)).astype(float)
    na, nb = c.sum(1, keepdims=True), c.sum(0, keepdims=True)
    assert msm.vamp_from_counts(c) == pytest.approx((c * c / (na * nb)).sum() - 1, abs=1e-6)
    assert msm.vamp_from_counts(np.array([[5.0]])) == pytest.approx(1, abs=1e-6)
    assert msm.vamp_from_counts(c, "VAMPE") == pytest.approx(3 - msm.vamp_from_counts(c), abs=1e-9)
    with pytest.raises(ValueError):
        msm.vamp_from_counts(np.ones((2, 3)))


def test_reversible_estimate_is_in_detailed_balance():
    t = msm.reversible(np.array([[10, 5, 1], [2, 20, 4], [3, 1, 9]], float), 1e-12)
    w, v = np.linalg.eig(t.T)
    pi = np.real(v[:, np.argmax(np.real(w))])
    flow = (pi / pi.sum())[:, None] * t
    assert flow == pytest.approx(flow.T, abs=1e-6) and t.sum(1) == pytest.approx(1)


def test_v_measure_ignores_label_names(spark):
    rows = spark.createDataFrame([(k % 3, (k * k) % 5) for k in range(60)], "truth int, pred int")
    a = scoring.v_measure(rows, "truth", "pred", []).first()
    b = scoring.v_measure(rows.withColumn("pred", 7 - F.col("pred")), "truth", "pred", []).first()
    assert a.v == pytest.approx(b.v) and 0 <= a.v <= 1
    assert scoring.v_measure(rows.withColumn("pred", F.col("truth")), "truth", "pred", []).first().v == pytest.approx(1)
    assert scoring.v_measure(rows.withColumn("truth", F.lit(0)), "truth", "pred", []).first().v is None


def test_adjusted_rand_of_equal_partitions(spark):
    rows = spark.createDataFrame([(k % 3, 9 - k % 3) for k in range(30)], "a int, b int")
    assert scoring.adjusted_rand(rows, "a", "b", []).first().ari == pytest.approx(1)


def test_spearman_with_ties(spark):
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in [(1, 1), (2, 1), (2, 3), (4, 2), (5, 5)]], "k string, a double, b double")
    r = reports.spearman(rows, "a", "b", ["k"]).first()
    assert r.rho == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4, 5], [1.5, 1.5, 4, 3, 5])[0, 1])
    assert reports.correlation_p(0.5, 20) == pytest.approx(0.0248, abs=5e-4)


def test_estimator_separates_levels(spark):
    x = np.concatenate([np.random.default_rng(k).normal(10 * (k % 2), 0.3, 100) for k in range(8)])
    rows = spark.createDataFrame([("a", 0, t, float(v), len(x)) for t, v in enumerate(x)], "series_id string, dim int, t long, x double, n long")
    model = SegmentClusterer(window=20, quantile=0.8, method="spectral", clusters=2)
    got = {r.t: r.label for r in model.fit_predict(rows, [0]).collect()}
    assert len(got) == len(x)
    inner = [got[100 * k + 50] for k in range(7)]
    assert len({*inner[::2]}) == 1 and len({*inner[1::2]}) == 1 and inner[0] != inner[1]
    with pytest.raises(NotImplementedError):
        model.predict(rows)


def uneven(rng, count, scale=5.0):
    return [np.sort(rng.normal(scale * (k % 3), 1 + k % 2, 1 + int(rng.integers(12)))) for k in range(count)]


def test_sample_matrix_equals_pairs_as_rows(spark):
    v = uneven(np.random.default_rng(3), 25)
    rows = segments.pairs(samples(spark, *v)).select("i", "j", segments.exact_w2(F.col("a"), F.col("b")).alias("d")).collect()
    got = clustering.sample_matrix(v)
    assert (got == got.T).all() and max(abs(got[r.i, r.j] - r.d) for r in rows) < 1e-12


def test_left_out_similarities_are_lost_in_rounding(monkeypatch):
    v = uneven(np.random.default_rng(4), 90, 40.0)
    want = clustering.gaussian(clustering.sample_matrix(v), 0.5)
    monkeypatch.setattr(clustering, "WHOLE", 10)
    got = clustering.sample_similarity(v, 0.5)
    assert (got == 0).any() and np.abs(got - want).max() < 1e-15


def test_product_matrix_equals_profile_matrix():
    v = np.sort(np.random.default_rng(5).exponential(50, (60, 40)), axis=1)
    v[7], v[9] = v[3], v[3] + 1e-7
    got, want = clustering.product_matrix(v), clustering.profile_matrix(v)
    assert got[3, 7] == 0 and got == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("scale", [0.5, 20.0, 2000.0])
def test_lowest_pairs_equal_a_whole_decomposition(monkeypatch, scale):
    x = np.random.default_rng(6).exponential(10, (300, 1))
    a = np.exp(-((x - x.T) ** 2) / scale)
    whole = clustering.laplacian(a)
    want = np.linalg.eigvalsh(whole)[:11]
    monkeypatch.setattr(clustering, "WHOLE", 10)
    values, vectors = clustering.lowest(a, 11)
    assert values == pytest.approx(want, abs=1e-9) and np.abs(whole @ vectors - vectors * values).max() < 1e-8
    assert vectors.T @ vectors == pytest.approx(np.eye(11), abs=1e-9)


def test_sweep_from_profiles_equals_sweep_from_pairs(spark):
    v = [(s, 0.0, k, sorted(map(float, np.random.default_rng(k).normal(9 * (k % 3), 1, 16)))) for s in "ab" for k in range(18)]
    rows = spark.createDataFrame(v, "series_id string, q double, seg long, v array<double>")
    got, want = (f.collect() for f in (clustering.profile_sigma_sweep(rows, [0.5, 3.0, 40.0], tasks=2), clustering.sigma_sweep(segments.sample_profile_distances(rows, 16), [0.5, 3.0, 40.0])))
    assert len(got) == 6 and {(r.series_id, r.sigma, r.n_used) for r in got} == {(r.series_id, r.sigma, r.n_used) for r in want}


@pytest.mark.parametrize("method", ["adp", "spectral"])
def test_estimator_makes_no_rows_of_pairs(spark, monkeypatch, method):
    rows = spark.createDataFrame([("a", 0, t, float(t // 50 % 2 * 9 + t % 7), 800) for t in range(800)], "series_id string, dim int, t long, x double, n long")
    model = SegmentClusterer(window=20, quantile=0.8, method=method, clusters=2)
    stat = model._statistic(rows, 0, 20)
    segs = model._labels(rows, 0, stat, [0.8])[1]
    want = clustering.segment_labels(segments.exact_distances(stat.select("series_id", "t", "x", "n"), segs.select("series_id", "q", "seg", "start", "end")), method, 2)
    key = lambda df: sorted((r.seg, r.label) for r in df.collect())
    assert key(segs) == key(want)

    def pairs(*_):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(segments, "pairs", pairs)
    assert model.fit_predict(rows, [0]).count() == 800
