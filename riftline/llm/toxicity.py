"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the 4- and 5-byte beginnings of its
words, hashed to 2^22 buckets. The machine scores

    w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)

over the selected terms present, so a pair of terms can weigh more, or less,
than the sum of its parts; an additive model cannot say that.

Fitting. Labels are read only from rows whose crc32(doc_id as text) mod 5 is
not 0. The fit uses at most ``sample_rows`` of them, those with the smallest
md5 of their id: a bounded, repeatable sample. Its terms are counted on the
executors. Kept are

* the ``max_terms`` terms with the largest chi-square against the label, and
* up to ``pair_terms`` more that matter only together with another term: among
  ``frequent`` frequent terms and as many of the first kind, those in a pair
  whose interaction (the difference of the one's log odds ratio with and without
  the other) is ``PAIR_Z`` standard errors from none.

So the model is a few hundred KB whatever the corpus, and only the kept terms of
the sample reach the driver. Weights are learned by minibatch AdaGrad on
logistic loss. Scoring covers every text whole.

Defined results: a null, empty or blank text scores the machine's bias, as any
text without selected terms does; a term counts once however often it is
repeated, so very long texts aren't favoured; with no usable labels, or labels
of one class, every score is the (smoothed) base rate; repeated rows get equal
scores; an empty table gives no rows; lang, source and every other column are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, word_hashes
from .workspace import Scratch

BITS = 22
PREFIXES = (4, 5)
#: Tasks that read the training sample.
TRAIN_PARTS = 12
#: The 5 % point of one degree of freedom.
LEAST_CHI = 3.84
#: Some 10^6 pairs are tried: at five standard errors fewer than one is there by chance.
PAIR_Z = 5.0


def terms(column: pa.Array):
    """For runs of rows: (first row, terms per row, buckets), each row's buckets distinct and sorted."""
    for first, data, offsets in pieces(column):
        counts, *kinds = word_hashes(data, offsets, PREFIXES)
        rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        key = np.concatenate([(rows << np.uint64(BITS)) | ((h + np.uint64(k * 0x9E37)) >> np.uint64(64 - BITS)) for k, h in enumerate(kinds)])
        key = np.unique(key)
        yield first, np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(counts)), (key & np.uint64((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Machine:
    bias: float
    terms: np.ndarray  # sorted buckets
    linear: np.ndarray
    factors: np.ndarray  # terms x rank

    def scores(self, counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Probability for each row of a ragged term array."""
        rows = np.repeat(np.arange(len(counts)), counts)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, buckets), len(self.terms) - 1)
            known = self.terms[at] == buckets
            rows, at = rows[known], at[known]
        else:
            rows, at = rows[:0], np.zeros(0, np.int64)
        z = self.bias + np.bincount(rows, self.linear[at], len(counts))
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            z += 0.5 * (np.bincount(rows, v, len(counts)) ** 2 - np.bincount(rows, v * v, len(counts)))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def chi_square(df, hits, n, positive):
    """Of a term's 2 x 2 table with the label, small expected counts discounted by one pseudo-row. Columns or arrays."""
    expected = df * (positive / n)
    return (hits - expected) ** 2 * (1 / (expected + 1) + 1 / (df - expected + 1))


def interacting(x: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """Columns of a 0/1 matrix in the strongest interactions with another column on the label, strongest first."""
    x = x.astype(np.float32)
    counts = []
    for rows in (x[labels > 0], x[labels == 0]):
        both, one = rows.T @ rows, rows.sum(0)
        only = one[:, None] - both  # the first term without the second
        counts.append((both, only, only.T, len(rows) - one[:, None] - one[None, :] + both))
    odds = [np.log((p + 0.5) / (q + 0.5)) for p, q in zip(*counts)]
    error = sum(1 / (p + 0.5) + 1 / (q + 0.5) for p, q in zip(*counts))
    z = np.abs(odds[0] - odds[1] - odds[2] + odds[3]) / np.sqrt(error)
    np.fill_diagonal(z, 0)
    best = z.max(1)
    order = np.argsort(-best, kind="stable")[:most]
    return order[best[order] >= PAIR_Z]


def incidence(parts, chosen: np.ndarray) -> np.ndarray:
    """A byte for each row of ``parts`` and each of the sorted buckets ``chosen``."""
    x, first = np.zeros((sum(len(p[2]) for p in parts), len(chosen)), np.uint8), 0
    for counts, buckets, y in parts:
        at = np.minimum(np.searchsorted(chosen, buckets), len(chosen) - 1)
        known = chosen[at] == buckets
        x[first + np.repeat(np.arange(len(y)), counts)[known], at[known]] = 1
        first += len(y)
    return x


def fit(parts, strong, frequent=(), rank: int = 4, epochs: int = 24, rate: float = 0.15, decay: float = 1e-4, pair_terms: int = 256, seed: int = 7) -> Machine:
    """A machine from parts (terms per row, buckets, labels), in a fixed order of rows.

    ``strong``: the buckets kept for themselves, strongest first; ``frequent``: those kept if they interact.
    """
    labels = np.concatenate([np.zeros(0), *[p[2] for p in parts]])
    n, positive = len(labels), int(labels.sum())
    base = (positive + 0.5) / (n + 1)
    empty = Machine(float(np.log(base / (1 - base))), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, rank)))
    if positive == 0 or positive == n:
        return empty
    strong = np.asarray(strong, np.int32)
    tried = np.union1d(strong[: len(frequent)], np.asarray(frequent, np.int32)).astype(np.int32)
    paired = tried[interacting(incidence(parts, tried), labels, 4 * pair_terms)] if len(tried) > 1 else tried[:0]
    more = paired[~np.isin(paired, strong)][:pair_terms]
    chosen = np.union1d(strong, more).astype(np.int32)
    if not len(chosen):
        return empty
    x = incidence(parts, chosen)
    rng = np.random.default_rng(seed)
    w0, w, v = empty.bias, np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), rank))
    g0, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(epochs):
        for take in np.array_split(rng.permutation(n), max(1, n // 256)):
            xb, y = x[take].astype(np.float64), labels[take]
            xv = xb @ v
            z = w0 + xb @ w + 0.5 * (xv**2 - xb @ (v * v)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(take)
            d0, dw = err.sum(), xb.T @ err + decay * w
            dv = xb.T @ (err[:, None] * xv) - v * (xb.T @ err)[:, None] + decay * v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            w0, w, v = w0 - rate * d0 / np.sqrt(g0), w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    return Machine(float(w0), chosen, w, v)


def crc_of_id(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(id_col: str):
    return F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(False))


SAMPLE = "_order string, _y int, _terms array<int>"


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 12_000,
    max_terms: int = 2048,
    frequent: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    **options,
) -> Machine:
    """A machine fitted on at most ``sample_rows`` labelled rows outside the held-out fifth."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y is not null and _id is not null")
    marked = marked.where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    marked = marked.withColumn("_order", F.md5(F.col("_id").cast("string"))).orderBy("_order").limit(int(sample_rows))
    # The labels kept are at most sample_rows, so they may be broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marked), "_id")

    def gather(it):
        for batch in it:
            for first, counts, buckets in terms(batch.column(0)):
                k = len(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(buckets, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(first, k), batch.column(1).slice(first, k), lists], ["_order", "_y", "_terms"])

    got = rows.select("_text", "_y", "_order").repartitionByRange(TRAIN_PARTS, "_order").mapInArrow(gather, SAMPLE)
    scratch = Scratch(docs.sparkSession)
    got = scratch.stage(got, "toxicity-sample")
    n, positive = got.agg(F.count("*"), F.coalesce(F.sum((F.col("_y") > 0).cast("int")), F.lit(0))).first()
    if not 0 < positive < n:
        scratch.drop(got)
        return fit([(np.zeros(n, np.int64), np.zeros(0, np.int32), (np.arange(n) < positive).astype(float))], [], **options)

    def count(it):
        """Rows with each bucket, and those of label 1, of a task."""
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in it:
            lists = batch.column(1)
            y = np.repeat(batch.column(0).to_numpy() > 0, lists.value_lengths().to_numpy(zero_copy_only=False))
            buckets = lists.flatten().to_numpy()
            seen[0] += np.bincount(buckets, minlength=1 << BITS).astype(np.int32)
            seen[1] += np.bincount(buckets[y], minlength=1 << BITS).astype(np.int32)
        used = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[0, used]), pa.array(seen[1, used])], ["bucket", "df", "hits"])

    counted = got.select("_y", "_terms").mapInArrow(count, "bucket int, df int, hits int")
    counted = counted.groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits")).where("df >= 2")
    counted = scratch.stage(counted, "toxicity-terms")
    chi = chi_square(F.col("df"), F.col("hits"), n, positive)
    strong = [r.bucket for r in counted.withColumn("chi", chi).where(F.col("chi") > LEAST_CHI).orderBy(F.col("chi").desc(), "bucket").limit(int(max_terms)).select("bucket").collect()]
    # a term in nearly all rows is no modifier
    often = [r.bucket for r in counted.where(F.col("df") <= 0.9 * n).orderBy(F.col("df").desc(), "bucket").limit(int(frequent)).select("bucket").collect()]
    wanted = np.unique(np.array(strong + often, np.int32))

    def pick(it):
        for batch in it:
            lists = batch.column(2)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            buckets = lists.flatten().to_numpy()
            keep = np.isin(buckets, wanted)
            ends = np.cumsum(np.bincount(rows[keep], minlength=len(lists)))
            few = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(buckets[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), few], ["_order", "_y", "_terms"])

    # at most sample_rows rows of max_terms + frequent terms; in one order, whatever the partitions are
    few = got.mapInArrow(pick, SAMPLE).toArrow().sort_by([("_order", "ascending"), ("_y", "ascending")]).combine_chunks()
    lists = few.column("_terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    part = (lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False), few.column("_y").to_numpy().clip(0, 1).astype(float))
    scratch.drop(got, counted)
    return fit([part], strong, often, **options)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def batches(it):
        for batch in it:
            for first, counts, buckets in terms(batch.column(2)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(counts)), batch.column(1).slice(first, len(counts)), pa.array(machine.scores(counts, buckets), pa.float64())],
                    ["doc_id", "held_out", "score"],
                )

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
    out = out.mapInArrow(batches, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` not predicted toxic, columns as they were."""
    at = docs.columns.index(text_col)

    def batches(it):
        for batch in it:
            keep = [machine.scores(counts, buckets) < 0.5 for _, counts, buckets in terms(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(batches, docs.schema)


QUERY = "op7_toxicity_machine"
ORACLE = None


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
