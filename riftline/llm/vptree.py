"""Approximate nearest neighbours: a vantage-point tree per shard.

The largest inner product becomes the smallest distance by one more component:
x -> (x, sqrt(M^2 - |x|^2)) with M the largest norm of the shard, q -> (q, 0);
then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>. A tree node splits its vectors at the
median distance to a vantage point. A query goes to the nearer side first and
visits the other only if

    factor * |d(q, vantage) - median| <= its k-th best distance,

the triangle inequality relaxed: factor one is exact, larger factors visit fewer
nodes. Queries descend together: at each node the ones still interested are one
array. Every vector is in a tree; scores are exact inner products of the
original vectors, in double precision.

Defined results: null, empty and zero vectors, those with null or non-finite
components and those of another than the most frequent length take no part as
query or candidate; a query never finds its own row; rows that repeat an id are
each a query and a candidate; equal scores go to the smaller id among those
found; fewer candidates than k give fewer rows; an empty table gives none; other
columns may have any names.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame

from .vectors import search, usable

K = 20
LEAF = 128
#: Relaxation of the pruning: README gives the recall measured with it.
FACTOR = 1.6


def lift(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]])


def build(ids: np.ndarray, names: np.ndarray, x: np.ndarray, leaf_size: int = LEAF) -> bytes:
    """Nodes in preorder: vantage row, median, first and last place of its vectors, second child (0: a leaf)."""
    y, order, nodes, rng = lift(x), np.arange(len(x)), [], np.random.default_rng(5)

    def grow(a: int, b: int):
        me = len(nodes)
        nodes.append([-1, 0.0, a, b, 0])
        if b - a <= leaf_size:
            return
        own = order[a:b]
        # of a few points the one whose distances spread most
        some, probe = rng.choice(own, 8), rng.choice(own, 64)
        vantage = max(some, key=lambda v: np.linalg.norm(y[probe] - y[v], axis=1).var())
        d = np.linalg.norm(y[own] - y[vantage], axis=1)
        half = (b - a) // 2
        by = np.argpartition(d, half)
        order[a:b] = own[by]
        nodes[me][:2] = vantage, d[by[half]]
        grow(a, a + half)
        nodes[me][4] = len(nodes)
        grow(a + half, b)

    grow(0, len(x))
    place = np.argsort(order)
    table = np.array(nodes)
    split = table[:, 0] >= 0
    table[split, 0] = place[table[split, 0].astype(int)]
    out = io.BytesIO()
    np.savez(out, ids=ids[order], names=names[order], x=x[order], y=y[order], nodes=table)
    return out.getvalue()


def probe_tree(data: bytes, own: np.ndarray, q: np.ndarray, k: int, factor: float):
    """(query place, row, id, score) of the k best found of each query; ``own``: the queries' rows."""
    with np.load(io.BytesIO(data)) as z:
        ids, names, x, y, nodes = (z[n] for n in ("ids", "names", "x", "y", "nodes"))
    lifted = np.hstack([q, np.zeros((len(q), 1))])
    # slack for rounding, so that factor one stays exact
    slack = 1e-9 * (1 + np.linalg.norm(lifted, axis=1) + np.linalg.norm(y[0]))
    offset = (q * q).sum(1) + (y[0] * y[0]).sum()  # |q|^2 + M^2
    kth = np.full(len(q), -np.inf)  # k-th best score so far
    found_at = np.full((len(q), k), len(ids))  # place of the row, after the last one: none
    ids_and_none = np.append(ids, np.iinfo(np.int64).max)
    names_and_none = np.append(names, np.iinfo(np.int64).max)
    found = np.full((len(q), k), -np.inf)

    def leaf(a, b, who):
        scores = q[who] @ x[a:b].T
        scores[own[who][:, None] == names[None, a:b]] = -np.inf
        useful = np.flatnonzero((scores >= kth[who][:, None]).any(1))
        who, scores = who[useful], scores[useful]
        s = np.hstack([found[who], scores])
        i = np.hstack([found_at[who], np.broadcast_to(np.arange(a, b), scores.shape)])
        # as many columns as the most that reach their row's k-th score, so that none of a tie is lost
        cut = np.partition(s, -k, axis=1)[:, -k, None]
        width = int((s >= cut).sum(1).max(initial=0))
        if 0 < width < s.shape[1]:
            part = np.argpartition(-s, width - 1, axis=1)[:, :width]
            s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
        take = np.lexsort((names_and_none[i], ids_and_none[i], -s), axis=1)[:, :k]
        found[who], found_at[who] = np.take_along_axis(s, take, 1), np.take_along_axis(i, take, 1)
        kth[who] = found[who, -1]

    def visit(n, who):
        vantage, median, a, b, second = nodes[n]
        if not len(who):
            return
        if not second:
            return leaf(int(a), int(b), who)
        d = np.linalg.norm(lifted[who] - y[int(vantage)], axis=1)
        inside = d < median
        for first_side, group, dist in ((True, who[inside], d[inside]), (False, who[~inside], d[~inside])):
            near, far = (n + 1, int(second)) if first_side else (int(second), n + 1)
            visit(near, group)
            reach = np.sqrt(np.maximum(offset[group] - 2 * kth[group], 0))
            visit(far, group[factor * (np.abs(dist - median) - slack[group]) <= reach])

    visit(0, np.arange(len(q)))
    place, col = np.nonzero(found > -np.inf)
    at = found_at[place, col]
    return place, names[at], ids[at], found[place, col]


def approximate_neighbours(
    vectors: DataFrame, k: int = K, every: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vec_col: str = "embedding", leaf: int = LEAF, shard: int | None = None, block: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``."""
    rows, row = usable(vectors, id_col, vec_col, zero_ok=False)
    grow = lambda ids, names, x: build(ids, names, x, leaf)
    return search(rows, row, rows.where(f"vec_id % {int(every)} = 0"), grow, lambda data, own, q: probe_tree(data, own, q, k, factor), k, "double", shard, block)


QUERY = "op5_vantage_point_forest"
ORACLE = None


def query(spark, sf_dir):
    return approximate_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
