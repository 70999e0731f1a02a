"""Exact top-k by largest integer inner product: best-first search in M-trees.

Vectors x become floor(64 x). A shard's M-tree is bulk-loaded: pages of ``PAGE``
entries; a routing entry has a centre, a covering radius and its distance to the
centre of the page above. For a query q,

    max over a page of <q, x>  <=  <q, c> + |q| r        (covering radius)
    <q, c>  <=  <q, parent> + |q| d(c, parent)           (stored parent distance)

so with s the k-th best score so far, an entry with <q, parent> + |q| (d + r) < s
is dropped without computing <q, c>, and one with <q, c> + |q| r < s without
opening its page. Pages are opened best bound first. Bounds are in doubles with
a margin for rounding; scores are exact integers, and only a bound strictly
below s drops an entry, so ties are kept.

Defined results: null and empty vectors, those with null or non-finite
components and those of another than the most frequent length take no part; zero
vectors do, with score 0; a query never finds its own row; rows that repeat an
id are each a query and a candidate; equal scores go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives none; other columns may
have any names. Vectors so long that a score may reach 2^53, beyond which doubles
aren't exact, are refused.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import search, usable

K = 20
PAGE = 256
SCALE = 64


def bulk_load(ids: np.ndarray, names: np.ndarray, x: np.ndarray, page_size: int = PAGE) -> bytes:
    """Leaf pages are runs of ``order``; the levels above group pages by nearest of some spread centres."""
    if (x * x).sum(1).max() >= 2.0**53:
        raise ValueError("vectors too long for exact integer scores")
    order, pages, rng = np.arange(len(x)), [], np.random.default_rng(3)

    def split(a: int, b: int):
        if b - a <= page_size:
            pages.append((a, b))
            return
        own = order[a:b]
        # two far points; the rest goes by difference of distances, halved
        p = x[own[int(rng.integers(len(own)))]]
        p = x[own[np.argmax(((x[own] - p) ** 2).sum(1))]]
        q = x[own[np.argmax(((x[own] - p) ** 2).sum(1))]]
        by = np.argsort(x[own] @ (q - p), kind="stable")
        order[a:b] = own[by]
        split(a, (a + b) // 2)
        split((a + b) // 2, b)

    split(0, len(x))
    x, ids, names = x[order], ids[order], names[order]
    # leaf level: entries are vectors; a page's centre is its mean
    bounds = np.array(pages)
    centres = np.array([x[a:b].mean(0) for a, b in pages])
    to_parent = np.concatenate([np.sqrt(((x[a:b] - c) ** 2).sum(1)) for (a, b), c in zip(pages, centres)])
    levels = [(np.zeros(len(x)), to_parent, bounds, centres)]
    while len(centres) > 1:
        # the radius covers the vectors below, not only the centres
        _, _, low, cs = levels[-1]
        radius = np.array([(levels[-1][0][a:b] + levels[-1][1][a:b]).max() for a, b in low])
        step = max(2, page_size // 16)
        groups = [(a, min(a + step, len(cs))) for a in range(0, len(cs), step)]
        centres = np.array([cs[a:b].mean(0) for a, b in groups])
        up = np.concatenate([np.sqrt(((cs[a:b] - c) ** 2).sum(1)) for (a, b), c in zip(groups, centres)])
        levels.append((radius, up, np.array(groups), centres))
    out = io.BytesIO()
    arrays = {f"{name}{i}": v for i, level in enumerate(levels) for name, v in zip(("radius", "up", "pages", "centres"), level)}
    np.savez(out, ids=ids, names=names, x=x, depth=len(levels), **arrays)
    return out.getvalue()


def best_first(data: bytes, own: np.ndarray, queries: np.ndarray, k: int):
    """(query place, row, id, score): the k best of each query, exactly; ``own``: the queries' rows."""
    with np.load(io.BytesIO(data)) as z:
        ids, names, x, depth = z["ids"], z["names"], z["x"], int(z["depth"])
        levels = [[z[f"{name}{i}"] for name in ("radius", "up", "pages", "centres")] for i in range(depth)]
    places, out_at, out_scores = [], [], []
    root = levels[-1][3][0]
    largest = np.sqrt((x * x).sum(1).max()) if len(x) else 0.0
    for place, (mine, q) in enumerate(zip(own, queries)):
        length = float(np.sqrt(q @ q))
        margin = 1e-9 * (1 + length * (1 + largest))
        kth, got_s, got_at = -np.inf, np.zeros(0), np.zeros(0, np.int64)
        heap, serial = [(-np.inf, 0, depth - 1, 0, float(q @ root))], 0
        while heap:
            bound, _, level, page, centre_score = heapq.heappop(heap)
            if -bound < kth - margin:
                break  # best first: all others are no better
            radius, up, pages, _ = levels[level]
            a, b = pages[page]
            entries = np.arange(a, b)
            # by the stored parent distance, before any inner product
            entries = entries[centre_score + length * (up[a:b] + radius[a:b]) >= kth - margin]
            if not len(entries):
                continue
            if level == 0:
                scores = x[entries] @ q
                keep = (scores >= kth) & (names[entries] != mine)
                if keep.any():
                    got_s, got_at = np.concatenate([got_s, scores[keep]]), np.concatenate([got_at, entries[keep]])
                    if len(got_s) > k:
                        take = np.lexsort((names[got_at], ids[got_at], -got_s))[:k]
                        got_s, got_at = got_s[take], got_at[take]
                    if len(got_s) == k:
                        kth = got_s.min()
            else:
                scores = levels[level - 1][3][entries] @ q
                bounds = scores + length * radius[entries]
                for e, s, u in zip(entries.tolist(), scores.tolist(), bounds.tolist()):
                    if u >= kth - margin:
                        serial += 1
                        heapq.heappush(heap, (-u, serial, level - 1, e, s))
        places.append(np.full(len(got_s), place))
        out_at.append(got_at)
        out_scores.append(got_s)
    at = np.concatenate(out_at)
    return np.concatenate(places), names[at], ids[at], np.concatenate(out_scores).astype(np.int64)


def exact_top_k(
    vectors: DataFrame, k: int = K, every: int = 20, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", page: int = PAGE, shard: int | None = None, block: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by ``every``."""
    rows, row = usable(vectors, id_col, vec_col, zero_ok=True)
    rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))
    load = lambda ids, names, x: bulk_load(ids, names, x, page)
    return search(rows, row, rows.where(f"vec_id % {int(every)} = 0"), load, lambda data, own, q: best_first(data, own, q, k), k, "long", shard, block)


QUERY = "op6_mtree_top_k"
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.e::DOUBLE[], x.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


def query(spark, sf_dir):
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
