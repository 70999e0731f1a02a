"""Time-varying curriculum over weighted sources.

Each source has a weight and a schedule: multipliers at equally spaced moments
of training, linear in between. A source's cumulative demand is its target
times the normalised integral of its schedule. Its documents, in a fixed
pseudo-random order, consume that demand; the moment at which the demand
reaches the words before a document is that document's training position. The
mix is the range-sort of all taken documents by position.

Targets: sources share ``ratio`` times all words by weight; a target stops at
``max_repeats`` times its source's words and the excess is shared again by
weight until none is above, found in closed form: sources sorted by
(cap / weight), of which a leading run is capped.

A document is taken in pass ``p`` when the middle of its words lies below the
target; so the words taken from a source differ from its target by at most half
of its longest document. A hot source spans many range partitions: prefix sums
join per-partition totals, so no task sees a whole source.

Defined results: a null or blank text has size 0, takes 0 words and still has a
row; the null source is one source, ordered last; repeated ids are ordered by
size and are otherwise interchangeable; an empty table gives no rows; other
columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sharding import prefix_sums, ranged
from .workspace import fresh, keyed, parallelism, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules by the same place: multipliers at equally spaced moments of training.
SCHEDULES = ((1.0, 1.0, 0.5), (0.5, 1.0, 1.0), (0.25, 1.0, 2.0))


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, ratio: float, max_repeats: float, weights) -> DataFrame:
    """_source, _source_size -> with _class, _weight, _target. One row for each source, the only rows its windows hold."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sources.withColumn("_class", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_weight", F.element_at(table, F.col("_class") + 1))
    ranked = ranked.withColumn("_cap", F.col("_source_size") * F.lit(float(max_repeats)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (
        F.sum("_source_size").over(everything) * F.lit(float(ratio)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_weight").over(rest)
    ranked = ranked.withColumn("_level", level).withColumn("_capped", F.col("_level") * F.col("_weight") >= F.col("_cap"))
    # The first source that isn't capped sets the level of all that follow.
    final = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_level")))).over(everything)
    ranked = ranked.withColumn("_final", final.getField("_level"))
    return ranked.withColumn(
        "_target", F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("_weight")))
    ).select("_source", "_source_size", "_class", "_weight", "_target")


def inverse_integral(share, cls, schedules):
    """The moment in [0, 1] at which a schedule's normalised integral reaches ``share``."""
    out = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        n = len(s) - 1
        areas = [(a + b) / 2 / n for a, b in zip(s, s[1:])]
        whole, done, cases = sum(areas), 0.0, []
        for i, area in enumerate(areas):
            # a + slope * x at x past the knot; integral a x + slope x^2 / 2
            slope, need = (s[i + 1] - s[i]) * n, share * F.lit(whole) - F.lit(done)
            root = need / F.lit(s[i]) if slope == 0 else (F.sqrt(F.greatest(F.lit(s[i] ** 2) + F.lit(2.0 * slope) * need, F.lit(0.0))) - F.lit(s[i])) / F.lit(slope)
            done += area
            cases.append((done / whole, F.lit(i / n) + F.least(F.greatest(root, F.lit(0.0)), F.lit(1 / n))))
        at = cases[-1][1]
        for upto, value in reversed(cases[:-1]):
            at = F.when(share <= F.lit(upto), value).otherwise(at)
        out = F.when(cls == k, at).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    ratio: float = 1.5,
    max_repeats: int = 2,
    weights=WEIGHTS,
    schedules=SCHEDULES,
    seed: str = "curriculum",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, position (of its first pass), next_position.

    ``row_col`` names a column that tells rows apart; it orders those alike in id and size, and stays.
    """
    row = [] if row_col is None else [row_col]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("_source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_order"),
        *row,
    )
    order = ["_source", "_order", "size", *row]
    parts = ranged(rows, order, "mix-ranges")
    goals = targets(parts.groupBy("_source").agg(F.sum("size").alias("_source_size")), ratio, max_repeats, weights)
    goals = stage(goals, "mix-targets")
    placed = prefix_sums(parts, order[1:], {"_start": "size"}, by=["_source"])
    placed = placed.join(goals, placed["_source"].eqNullSafe(goals["_source"])).drop(goals["_source"])
    taken_in = lambda p: (F.col("_start") + F.col("size") / 2 + F.lit(p) * F.col("_source_size")) < F.col("_target")
    passes = sum((taken_in(p).cast("int") for p in range(1, max_repeats)), taken_in(0).cast("int"))
    at = lambda p: inverse_integral((F.col("_start") + F.lit(p) * F.col("_source_size")) / F.col("_target"), F.col("_class"), schedules)
    return placed.withColumn("passes", passes).select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * F.col("passes")).alias("taken"),
        "passes",
        F.array(*[F.when(F.col("passes") > p, at(p)) for p in range(max_repeats)]).alias("positions"),
        *row,
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The training mix: rows of ``docs`` as often as they are taken, range-sorted by position, with the columns of ``docs``.

    A row's plan is joined to it by a key of the row, as ids may be null or repeated.
    """
    rows, row = keyed(docs, "mix-rows")
    at = fresh(rows, "_mix_at")
    plan = mix(rows, id_col=id_col, row_col=row, **options)
    plan = plan.where("passes > 0").select(row, F.explode(F.filter("positions", lambda x: x.isNotNull())).alias(at))
    out = rows.join(plan, row)
    order = [at, id_col, row]
    return out.repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order).drop(at, row)


QUERY = "op9_curriculum_mix"


def query(spark, sf_dir):
    """A row per document in the order of training: by the position of its first pass, those not taken last."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = lambda p: F.round(F.get("positions", F.lit(p)), 9)
    out = out.select("doc_id", "size", "source_size", "target", "taken", "passes", at(0).alias("position"), at(1).alias("next_position"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('curriculum:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][k % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT (SELECT level FROM l WHERE NOT level * weight >= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS level
), g AS (
  SELECT l.source, l.k, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target FROM l, f
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.k % 3 AS cls,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), knots(cls, i, y) AS (
  VALUES (0, 0, 1.0::DOUBLE), (0, 1, 1.0), (0, 2, 0.5), (1, 0, 0.5), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 0.25), (2, 1, 1.0), (2, 2, 2.0)
), pieces AS (  -- of each schedule: where a piece begins and ends as a share of the whole integral
  SELECT cls, i, y, slope, whole, done, (done + area) / whole AS upto, done / whole AS since
  FROM (SELECT *, sum(area) OVER (PARTITION BY cls) AS whole, sum(area) OVER (PARTITION BY cls ORDER BY i) - area AS done
        FROM (SELECT cls, i, y, (z - y) * 2 AS slope, (y + z) / 4 AS area FROM (SELECT *, lead(y) OVER (PARTITION BY cls ORDER BY i) AS z FROM knots) WHERE z IS NOT NULL))
), passes AS (
  SELECT p.*, pass, (start + pass * source_size) / target AS share, start + size / 2 + pass * source_size < target AS taken
  FROM p, (VALUES (0), (1)) t(pass)
), moments AS (
  SELECT m.*, round(i / 2.0::DOUBLE + least(greatest(CASE WHEN slope = 0 THEN (share * whole - done) / y
           ELSE (sqrt(greatest(y * y + 2 * slope * (share * whole - done), 0)) - y) / slope END, 0), 0.5), 9) AS moment
  FROM passes m LEFT JOIN pieces s ON m.cls = s.cls AND m.taken AND (share > since OR i = 0) AND (share <= upto OR i = 1)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * n AS BIGINT) AS taken, n AS passes, position, next_position FROM (
  SELECT doc_id, start, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
         CAST(sum(CAST(taken AS INTEGER)) AS INTEGER) AS n, max(CASE WHEN pass = 0 THEN moment END) AS position, max(CASE WHEN pass = 1 THEN moment END) AS next_position
  FROM moments GROUP BY doc_id, source_size, start)
"""
