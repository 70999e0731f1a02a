"""Vector searches against all inner products."""

import math

import numpy as np
import pytest

from riftline.llm import mtree, vptree

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[200]  # ties
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(5000, None, 0), (5020, [math.nan] * 16, 0), (5040, [math.inf] + [0.0] * 15, 0), (5060, [None] + [1.0] * 15, 0), (5080, [0.0] * 16, 0), (None, [1.0] * 16, 0)]
    return spark.createDataFrame(rows + odd, SCHEMA), x.astype(float)


def best(ids, x, scores, k=20):
    return np.lexsort((ids, -scores))[:k]


@pytest.mark.parametrize("shard, page, block", [(8192, 256, 1024), (300, 8, 30)])
def test_exact_search(table, shard, page, block):
    df, x = table
    ids = np.append(np.arange(1500), 5080)
    v = np.floor(64 * np.vstack([x, np.zeros(16)]))
    got = {}
    for r in mtree.exact_top_k(df, page=page, shard=shard, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {*range(0, 1500, 20), 5080}
    for q, hits in got.items():
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        top = best(ids, v, s)
        assert [hits[r] for r in range(1, 21)] == [(int(ids[i]), int(s[i])) for i in top]


def recall(df, x, factor, **sizes):
    got = {}
    for r in vptree.approximate_neighbours(df, factor=factor, **sizes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, rows in got.items():
        s = x @ x[q]
        assert all(score == pytest.approx(s[i]) for _, i, score in rows) and q not in [i for _, i, _ in rows]
        s[q] = -np.inf
        assert [i for _, i, _ in sorted(rows)] == [i for _, i, _ in sorted(rows, key=lambda r: (-r[2], r[1]))]
        hits += sum(sc >= np.sort(s)[-20] - 1e-9 for _, _, sc in rows)
    return hits / (20 * len(got))


@pytest.mark.parametrize("sizes", [{"leaf": 32}, {"leaf": 16, "shard": 300, "block": 20}])
def test_factor_one_is_exact_and_the_default_is_close(table, sizes):
    df, x = table
    assert recall(df, x, 1.0, **sizes) == 1
    assert recall(df, x, vptree.FACTOR, **sizes) >= 0.9


@pytest.mark.parametrize("copies", [60, 128, 700])
def test_ties_go_to_the_smaller_ids(copies):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64))
    x[rng.choice(1000, copies, replace=False)] = x[0] = rng.normal(size=64) * 2
    ids = rng.permutation(1000).astype(np.int64)
    names = np.arange(1000) + 7
    place, row, found, score = vptree.probe_tree(vptree.build(ids, names, x), names[:8], x[:8], 20, 1.0)
    for q in range(8):
        s = (x * x[q]).sum(1).round(9)
        s[q] = -np.inf
        assert found[place == q].tolist() == ids[best(ids, x, s)].tolist()
        assert (ids[row[place == q] - 7] == found[place == q]).all()


@pytest.mark.parametrize("page", [4, 16, 256])
def test_deep_trees_are_exact(page):
    rng = np.random.default_rng(page)
    x = np.floor(64 * rng.normal(size=(2500, 8)))
    x[:90] = x[100]
    ids = rng.permutation(2500).astype(np.int64)
    place, row, found, score = mtree.best_first(mtree.bulk_load(ids, np.arange(2500), x, page), np.arange(40), x[:40], 20)
    for q in range(40):
        s = x @ x[q]
        s[q] = -np.inf
        top = best(ids, x, s)
        assert found[place == q].tolist() == ids[top].tolist() and score[place == q].tolist() == s[top].astype(int).tolist()
    with pytest.raises(ValueError):
        mtree.bulk_load(ids, ids, x * 2.0**22, page)


SEARCHES = [mtree.exact_top_k, lambda df, **sizes: vptree.approximate_neighbours(df, factor=1.0, **sizes)]


@pytest.mark.parametrize("search", SEARCHES)
def test_repeated_rows_and_lengths(spark, search):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (20, [5.0]), (2, [1.0, 2.0, 3.0]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("taken") for c in ("v", "shard", "query", "row", "rank", "score", "_row_key")})
    for sizes in ({}, {"shard": 2}):
        got = sorted((r.query_id, r.rank, r.vec_id) for r in search(df, **sizes).collect())
        # two queries of id 0, each without its own row only; all scores tie; other lengths take no part
        assert got == [(0, 1, 0)] * 2 + [(0, 2, 1)] * 2 + [(0, 3, 1)] * 2


@pytest.mark.parametrize("search", [mtree.exact_top_k, vptree.approximate_neighbours])
def test_few_and_no_vectors(spark, search):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [3.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in search(few).collect()] == [(0, 1, 1)]
    assert search(few.limit(0)).count() == 0
