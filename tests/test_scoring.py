"""One-to-one matching, its scores, offsets and what is composed of them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riftline.operators import evaluation as E
from riftline.operators.scoring import match_pairs, nearest, offset_stats, score, strip_ends

KEYS = ["series_id"]


def best_matching(p, c, tau):
    """(size, -displacement) of the best of all one-to-one matchings."""
    best = (0, 0)
    for k in range(min(len(p), len(c)) + 1):
        for left in itertools.combinations(range(len(p)), k):
            for right in itertools.permutations(range(len(c)), k):
                gaps = [abs(p[i] - c[j]) for i, j in zip(left, right)]
                if all(g <= tau for g in gaps):
                    best = max(best, (k, -sum(gaps)))
    return best


def draws(seed, count=150, top=40):
    rng = random.Random(seed)
    for _ in range(count):
        yield [rng.randrange(top) for _ in range(rng.randrange(5))], [rng.randrange(top) for _ in range(rng.randrange(5))], rng.randrange(12)


def test_matching_is_optimal():
    for p, c, tau in draws(4):
        pairs = match_pairs(p, c, tau)
        assert (len(pairs), -sum(abs(p[i] - c[j]) for i, j in pairs)) == best_matching(p, c, tau)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_scores_follow_from_the_matching():
    for p, c, tau in draws(9, 60):
        ramps = [(2 * k, 2 * k + 1) for k in c] or [(3, 8)]
        truth = sorted(t for r in ramps for t in r)
        s = score(p, ramps, tau, 35)
        inner = [t for t in p if 0 < t < 34]
        assert strip_ends(p, 35) == inner and s["n_predicted"] == len(inner) and s["n_true"] == len(truth)
        hits = len(match_pairs(inner, truth, tau))
        assert s["n_matched"] == hits and s["recall"] == hits / len(truth)
        assert s["precision"] == (hits / len(inner) if inner else 0.0)
        assert s["f1"] == pytest.approx(2 * hits / (len(inner) + len(truth)) if hits else 0.0)


def test_scores_of_shifted_series_are_the_same_and_grow_with_the_tolerance():
    ramps, found = [(37, 52), (201, 203), (340, 399)], [12, 41, 60, 198, 207, 371, 372]
    curve = [score(found, ramps, tau, 1000) for tau in range(0, 40, 3)]
    moved = [score([t + 17 for t in found], [(a + 17, b + 17) for a, b in ramps], tau, 1000) for tau in range(0, 40, 3)]
    assert curve == moved
    assert [s["n_matched"] for s in curve] == sorted(s["n_matched"] for s in curve) and curve[0]["n_matched"] == 0 and curve[-1]["recall"] == 1


def test_without_truth_there_is_no_score():
    with pytest.raises(ValueError):
        score([7], [], 3, 50)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_points(spark, seed=3, count=60, top=3000):
    rng = random.Random(seed)
    p = {g: sorted(rng.sample(range(1, top), count)) for g in "ab"}
    c = {g: sorted(rng.sample(range(1, top), 2 * count // 3)) for g in "ab"}
    points = table(spark, [(g, t) for g, v in p.items() for t in v], "series_id string, t long")
    truth = table(spark, [(g, t, "small" if k % 3 else "big") for g, v in c.items() for k, t in enumerate(v)], "series_id string, truth long, size string")
    return p, c, points, truth


def test_matching_by_runs_is_the_whole_matching(spark):
    p, c, points, truth = random_points(spark)
    for tau in (4, 20, 200):
        got = E.matched(points, truth, tau, KEYS).collect()
        for g in "ab":
            want = match_pairs(p[g], c[g], tau)
            pairs = [(r.t, r.truth) for r in got if r.series_id == g]
            assert len(pairs) == len(want) and sum(abs(a - b) for a, b in pairs) == sum(abs(p[g][i] - c[g][j]) for i, j in want)
    stats = {r.series_id: r for r in E.pair_scores(points, truth, 20, KEYS).collect()}
    for g in "ab":
        want = match_pairs(p[g], c[g], 20)
        assert stats[g].precision == pytest.approx(len(want) / 60) and stats[g].recall == pytest.approx(len(want) / 40)
        assert stats[g].median_abs_error == np.median([abs(a - b) for a, b in ((r.t, r.truth) for r in E.matched(points, truth, 20, KEYS).collect() if r.series_id == g)])
    nothing = E.pair_scores(points.where("t < 0"), truth, 20, KEYS).collect()
    assert [(r.precision, r.recall, r.f1, r.median_abs_error) for r in nothing] == [(0.0, 0.0, 0.0, None)] * 2


def test_hits_by_size(spark):
    p, c, points, truth = random_points(spark, seed=8)
    out = E.classified(points, truth, 15, KEYS).collect()
    recall = {r.series_id: r for r in E.recall_by_size(points, truth, 15, KEYS).collect()}
    for g in "ab":
        small, big = [t for k, t in enumerate(c[g]) if k % 3], [t for k, t in enumerate(c[g]) if not k % 3]
        mine = [r for r in out if r.series_id == g]
        assert len(mine) == 60 and all(r.is_miss != (r.is_small or r.is_big) for r in mine)
        assert sum(r.is_small for r in mine) == len(match_pairs(p[g], small, 15)) and sum(r.is_big for r in mine) == len(match_pairs(p[g], big, 15))
        assert recall[g].small_recall == pytest.approx(len(match_pairs(p[g], small, 15)) / len(small))
        assert recall[g].precision == pytest.approx(len(match_pairs(p[g], c[g], 15)) / 60)


def test_offsets_and_their_sign(spark):
    ramps = table(spark, [("a", 50, 90), ("a", 90, 130)], "series_id string, start long, end long")
    points = table(spark, [("a", t) for t in (45, 57, 86, 93, 120, 141)], "series_id string, t long")
    plain = {r.t: (r.truth, r.offset) for r in nearest(points, E.true_points(ramps).select("series_id", "truth").distinct(), KEYS).collect()}
    assert plain == {45: (50, -5), 57: (50, 7), 86: (90, -4), 93: (90, 3), 120: (130, -10), 141: (130, 11)}
    out = E.localisation(points, ramps, KEYS).first()
    signed = [-5, 7, -4, 3, 10, -11]  # 90 is an end and a start: it counts as a start
    assert out.n == 6 and out.mean_signed == pytest.approx(np.mean(signed)) and out.median_signed == np.median(signed)
    assert out.p90_abs == pytest.approx(np.percentile(np.abs(signed), 90)) and offset_stats(nearest(points, E.true_points(ramps).select("series_id", "truth").distinct(), KEYS), KEYS).first().mean_abs == pytest.approx(np.mean(np.abs(signed)))


def test_random_points_by_chance(spark):
    counts = table(spark, [("x", 0), ("y", 40)], "series_id string, n int")
    truth = table(spark, [(g, 100 * k) for g in "xy" for k in range(1, 10)], "series_id string, truth long")
    got = {r.series_id: r.chance for r in E.chance_recall(counts, truth, 1000, 10, 25, KEYS).collect()}
    assert got["x"] == 0 and 0.3 < got["y"] < 0.8


def test_laws_of_states_and_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [("a", s, s, float(rng.normal(10 * s))) for s in (0, 1, 2) for _ in range(200)] + [("a", 0, 7, 0.5)] * 3
    df = table(spark, rows, "series_id string, truth int, pred int, x double")
    out = E.both_errors(df, "truth", "pred", KEYS).first()
    assert out.fidelity3 < 0.2 and out.separation3 == pytest.approx(20, abs=0.5) and out.fidelity_norm3 == pytest.approx(out.fidelity3 / out.separation3)
    report = E.cluster_report(df, "truth", "pred", KEYS).collect()
    assert [r.nearest for r in report] == [r.cluster for r in report] and all(abs(r.std - 1) < 0.2 for r in report)
    two = E.two_targets(df, "truth", "pred", KEYS).first()
    assert two.k == 4 and 0.95 < two.v3 < 1 and two.v2 > 0.9
    flags = E.composition_flags(E.composition(df.withColumn("seg", F.col("pred")), "pred", KEYS, F.abs(F.col("x")) < 3), KEYS).first()
    assert flags.has_transition_cluster and flags.k == 4 and flags.cluster_n_points.split(";")[-1] == "2:200"
