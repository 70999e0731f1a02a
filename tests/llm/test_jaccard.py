"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riftline.llm import bitmap, components, jaccard, words, workspace

from .common import ODD, SCHEMA, clashing, near_copies, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    least = list(range(len(sets)))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                if sets[p][0] > sets[q][0]:
                    p, q = q, p
                least[q] = p
    return {i: (len(s), sets[root(k)][0]) for k, (i, s) in enumerate(sets)}


def result(df, width, percent, **sizes):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, width, percent, **sizes).collect()}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 90)])
def test_equals_all_pairs(spark, width, percent):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, width, percent) == brute(rows, width, percent)


def test_small_blocks_and_deep_recursion(spark, monkeypatch):
    rows = near_copies(seed=8, count=220, words=40)
    monkeypatch.setattr(jaccard, "ROUND_PIVOTS", 3)  # read where the plan is made
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, 3, 80, block=7, leaf=5) == brute(rows, 3, 80)


def test_rounds_of_pivots_on_a_large_group(spark, monkeypatch):
    """A group of near copies, a chain that drifts away from it, and strangers, in blocks far below its size."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts, drift = [], list(base)
    for k in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    for k in range(40):
        drift[k] = f"y{k}"
        texts.append(" ".join(drift))
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 20
    for pivots, block in ((2, 12), (24, 40)):
        monkeypatch.setattr(jaccard, "ROUND_PIVOTS", pivots)
        assert result(df, 3, 85, block=block) == want


def test_leaf_and_regions_agree():
    rows = near_copies(seed=5, count=150, words=60)
    (_, sizes, h), = words.shingle_sets(pa.array([t for _, t in rows]), 3)
    whole, parts = (jaccard.Metric(sizes, h, jaccard.Threshold(80), leaf=4) for _ in range(2))
    members = np.flatnonzero(sizes)
    whole.pairs(members)
    parts.join(members)
    same = lambda m: [list(m.label).index(x) for x in m.label]
    assert same(whole) == same(parts)


def test_linked_sets_share_a_signature():
    rows = near_copies(seed=11, count=200, words=200)
    for percent in (80, 85, 90):
        t = jaccard.Threshold(percent)
        (_, sizes, h), = words.shingle_sets(pa.array([x for _, x in rows]), 3)
        row, sig = jaccard.signatures(sizes, h, t)
        of = [set(sig[row == k].tolist()) for k in range(len(rows))]
        sets = [set(x.tolist()) for x in np.split(h, np.cumsum(sizes)[:-1])]
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    assert of[a] & of[b]


@pytest.mark.parametrize("percent", [50, 79, 101])
def test_unsupported_similarities_are_refused(percent):
    with pytest.raises(ValueError):
        jaccard.Threshold(percent)


def test_odd_texts(spark):
    got = result(clashing(odd(spark)), 3, 90)
    assert got == brute([(r[0], r[1]) for r in ODD], 3, 90)
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[5] == got[9] == (5, 4) and got[6] == (1, 6)
    assert result(odd(spark, [*ODD, ODD[3]]), 3, 90) == got


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_keeps_columns(spark):
    out = jaccard.one_of_each(odd(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, workspace.Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}


def test_bitmap_lets_every_member_pass(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("key"), F.lit("taken").alias("_bitmap_at"))
    table = rows.where("key % 5 = 0 or key is null").select(F.col("key").alias("k"))
    out = bitmap.with_maybe(rows, F.col("key"), table, "k")
    assert out.columns == ["key", "_bitmap_at", "_maybe"] and out.count() == 4000
    assert out.where("not _maybe and (key % 5 = 0 or key is null)").count() == 0
    assert out.where("_maybe and key % 5 <> 0").count() < 10


def test_stages_are_deleted(spark):
    scratch = workspace.Scratch(spark)
    table = scratch.stage(spark.range(5), "test-scratch")
    (path,) = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    scratch.drop(table)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_parities_tell_unrelated_long_sets_apart():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, n, dtype=np.uint64)])) for n in (1950, 2000, 2050, 900, 40, 0)]
    sets += [np.concatenate([sets[0][100:], sets[1][:100]])]
    sizes = np.array([len(s) for s in sets])
    parities = jaccard.Parities(jaccard.sketches(sizes, np.concatenate(sets)))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart, true = parities.pairs_apart(a, b), np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert (apart <= true).all() and (apart[a == b] == 0).all()
    near = jaccard.Threshold(80).may_link(apart, sizes[a], sizes[b])
    assert sorted(zip(a[near & (a < b)], b[near & (a < b)])) == [(0, 6)]
    every = parities.among(0, len(sets))
    assert all((every(i, np.arange(len(sets))) <= true[b == i]).all() for i in range(len(sets)))


def test_regions_of_the_same_sets_are_one(spark):
    rows = spark.createDataFrame([(sig, h) for sig, hs in ((1, (5, 6)), (2, (6, 5)), (3, (5, 6, 7)), (4, (7, 8)), (5, (7, 8)), (6, (9,))) for h in hs], "sig long, h long")
    got = {}
    for r in jaccard.distinct_regions(rows).collect():
        got.setdefault(r.sig, []).append(r.h)
    assert sorted(sorted(x) for x in got.values()) == [[5, 6], [5, 6, 7], [7, 8]]
