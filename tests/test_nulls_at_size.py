import random

import pytest
from pyspark.sql import functions as F

from riftline.operators import clustering as C
from riftline.operators import evaluation as E
from riftline.operators import nulls as N
from riftline.operators import scoring as M
from riftline.operators import segments as S


def series(spark):
    rng = random.Random(4)
    rows = [("a", t, rng.gauss(0, 1) + t % 7, 300) for t in range(300)] + [("b", t, float(t % 5), 90) for t in range(90)] + [("c", t, 1.0 * t, 12) for t in range(12)]
    return spark.createDataFrame(rows, "series_id string, t long, x double, n long")


def cuts(df):
    return {r.series_id: (r.q, round(r.cutoff, 9)) for r in df.collect()}


@pytest.mark.parametrize("scheme", ["shuffle", "circular", "moving"])
@pytest.mark.parametrize("errors", [(6.0, 24.0, float("inf")), (0.0, float("inf"))])
def test_drawn_in_tasks_equals_drawn_as_rows(spark, monkeypatch, scheme, errors):
    monkeypatch.setattr(N, "ERRORS", errors)
    rows = series(spark)
    drawn = N.permuted(rows, 20) if scheme == "shuffle" else N.block_bootstrap(rows, 20, 7, scheme)
    null = N.null_statistics(drawn, 8).cache()
    want = cuts(N.pointwise_cutoff(null, 0.7))
    assert cuts(N.null_cutoff(rows, 8, 0.7, scheme, 20, 7)) == want
    if errors[0]:
        assert cuts(N.null_max_cutoff(rows, 8, 0.7, scheme, 20, 7)) == cuts(N.max_cutoff(null, 0.7))
        key = lambda r: (r.series_id, r.rep, r.t)
        assert sorted(N.null_rows(rows, 8, scheme, 20, 7).collect(), key=key) == sorted(null.collect(), key=key)
        lengths = spark.createDataFrame([("a", 7), ("b", 3)], "series_id string, block_length int")
        if scheme != "shuffle":
            null = N.null_statistics(N.block_bootstrap(rows, 20, lengths, scheme), 8)
            assert cuts(N.null_cutoff(rows, 8, 0.7, scheme, 20, lengths)) == cuts(N.pointwise_cutoff(null, 0.7))


def test_a_bootstrap_is_not_broadcast(spark):
    plan = N.block_bootstrap(series(spark), 30, 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [series_id" not in plan and "SortMergeJoin [series_id" in plan


def test_pairs_are_counted_without_a_table_of_them():
    rng = random.Random(2)
    for _ in range(300):
        p, c = (sorted(rng.choices(range(60), k=rng.randrange(12))) for _ in range(2))
        tau = rng.randrange(9)
        assert M.count_pairs(p, c, tau) == len(M.match_pairs(p, c, tau))
    assert M.count_pairs(list(range(0, 400_000, 2)), list(range(1, 400_000, 4)), 5) == 100_000


def test_typical_rep_ties_to_twelve_digits(spark):
    rows = spark.createDataFrame([(1, 5, 0.3), (1, 2, 0.1 + 0.2), (1, 9, 0.3 - 2e-16), (1, 7, 0.3 + 1e-15), (1, 3, 0.9), (1, 4, -0.3)], "k int, rep int, v double")
    assert [r.rep for r in E.typical_rep(rows, ["k"], "v").collect()] == [2]


@pytest.mark.parametrize("method", ["adp", "spectral"])
def test_labels_from_profiles_equal_those_from_pairs(spark, method):
    rng = random.Random(8)
    rows = [(s, t, rng.gauss(t // 20 % 3 * 5.0, 1), 600) for s in ("a", "b") for t in range(600)]
    rows = spark.createDataFrame([*rows, *[("c", t, 1.0, 30) for t in range(30)]], "series_id string, t long, x double, n long")
    segs = rows.where("t % 20 = 0").select("series_id", F.lit(0.5).alias("q"), (F.col("t") / 20).cast("long").alias("seg"), F.col("t").alias("start"), F.least(F.col("t") + 20, F.col("n")).alias("end"))
    got, want = C.profile_labels(S.profiles(rows, segs), method), C.segment_labels(S.profile_distances(rows, segs), method)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.where("status = 'ok'").count() == 60


def test_digests_of_many_numbers_equal_hashlib():
    import hashlib

    for head in (b"0-0-", b"7-198-", b"x" * 53):
        want = [int.from_bytes(hashlib.md5(head + b"%d" % t).digest()[:8], "big") for t in range(1203)]
        assert N._md5_heads(head, 1203).tolist() == want


@pytest.mark.parametrize("w", [1, 2, 7, 25, 64])
def test_merged_windows_equal_sorted_ones(w):
    import numpy as np

    from riftline.operators import windows as W

    x = np.random.default_rng(w).exponential(50, 5000).round(1)
    assert (np.stack(W.merged_windows(x, w), 1) == W.sorted_windows(x, w)).all()
    s = W.sorted_windows(x, w)
    assert (W.line_gaps(x, w) == np.sqrt(((s[w:] - s[:-w]) ** 2).sum(1) / w)).all()


def test_points_of_segments_are_not_broadcast(spark):
    rows = series(spark)
    segs = rows.groupBy("series_id").agg(F.max("n").alias("end")).select("series_id", F.lit(0.5).alias("q"), F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("start"), "end")
    times = N.segment_times(rows.repartition("series_id"), segs, 10, 2)
    assert times.count() == 2
    times.collect()
    plan = times._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin [series_id" in plan and "BroadcastHashJoin [series_id" not in plan


def test_times_of_segments_of_a_task_equal_those_of_each(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK", 64)
    rows = series(spark).withColumn("x", F.when(F.expr("series_id <> 'b' or t <> 70"), F.col("x")))
    x = {k: [r.x for r in rows.where(F.col("series_id") == k).orderBy("t").collect()] for k in "abc"}
    cuts_ = {"a": [0, 30, 31, 90, 200, 300], "b": [0, 60, 90], "c": [0, 12]}
    segs = spark.createDataFrame([(k, q, s, a, b) for k, c in cuts_.items() for q in (0.2, 0.7) for s, (a, b) in enumerate(zip(c, c[1:]))], "series_id string, q double, seg long, start long, end long")
    got = {(r.series_id, r.q, r.seg): r.tau for r in N.segment_times(rows, segs, 15, 3).collect()}
    want = {}
    for r in segs.collect():
        if r.end - r.start - 6 >= 15:
            want[r.series_id, r.q, r.seg] = None if r.series_id == "b" and r.seg == 1 else N.integrated_time(x[r.series_id][r.start + 3 : r.end - 3])[0]
    assert got == want and len(want) == 12
    known = {r.series_id: r.global_tau for r in N.auto_block_length(rows, segs, 3, 15).collect()}
    assert known == {"a": N.integrated_time(x["a"])[0], "b": None, "c": N.integrated_time(x["c"])[0]}
