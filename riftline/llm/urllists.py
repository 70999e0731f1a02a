"""Temporal URL filter: captures against the list entries active when they were fetched.

A list is a log of dated changes: at ``at`` a key is set to a verdict, or its entry
is withdrawn (verdict null). Changes of one key become validity intervals
[at, next at). A capture is looked up under its host and the host's parent
domains; the as-of join finds for each of these keys the last interval that began
at or before the fetch time, which counts if it hasn't ended, and the most
specific key with an active entry decides.

The as-of join puts the intervals' beginnings and the moments asked for of a key
in one order, and carries the last interval forward. It does so within buckets
of time: what is carried into a bucket is found first, from one row for each
bucket in which a key is asked for. So a hot host is many tasks. A moment of a
key is asked for once, however many captures share it.

Defined results: a null or unparsable URL, or a null fetch time, matches nothing;
a host that is an address (IPv4, or IPv6 in brackets) has no parent domains;
changes of one key at the same moment: the last verdict in order wins, a withdrawal
before any verdict; an entry is active from its moment on, inclusive; repeated captures are
each evaluated; without captures there are no rows, without entries all pass;
other columns of the captures may have any names and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units of time (of the time columns: days, say) in a bucket.
BUCKET = 64


def host_of(url):
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)", 1))
    return F.when(F.length(host) > 0, host)


def intervals(entries: DataFrame) -> DataFrame:
    """entry_key, verdict, since, until (null: open) from changes entry_key, at, verdict."""
    last = entries.where("entry_key is not null and at is not null").groupBy("entry_key", "at").agg(F.max("verdict").alias("verdict"))
    by_key = Window.partitionBy("entry_key").orderBy("at")
    spans = last.withColumn("until", F.lead("at").over(by_key)).withColumnRenamed("at", "since")
    return spans.where("verdict is not null")


ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$"


def keys_of(host):
    """The host and its parent domains of two labels or more, the host first; of an address only itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    lengths = F.when(host.rlike(ADDRESS) | (n < 2), F.array(n)).otherwise(F.sequence(n, F.lit(2), F.lit(-1)))
    return F.transform(lengths, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def as_of(asked: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """entry_key, fetched, span of the distinct rows of ``asked`` (entry_key, fetched) whose last span began at or before and hasn't ended."""
    span = F.struct("since", "until", "verdict")
    kind = spans.select(span.alias("s")).schema["s"].dataType
    bucket = lambda c: F.floor(F.col(c) / width)
    asked = asked.withColumn("_b", bucket("fetched"))
    # what holds when a bucket begins: a row for each bucket asked for, and the changes, of a key in order
    entered = asked.select("entry_key", "_b").distinct().select("entry_key", "_b", (F.col("_b") * width).alias("_at"), F.lit(None).cast(kind).alias("_s"))
    changes = spans.select("entry_key", bucket("since").alias("_b"), F.col("since").cast("double").alias("_at"), span.alias("_s"))
    by_key = Window.partitionBy("entry_key").orderBy("_at", F.col("_s").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = entered.unionByName(changes).withColumn("_c", F.last("_s", True).over(by_key)).where("_s is null and _c is not null")
    carried = carried.select("entry_key", "_b", (F.col("_b") * width).cast("double").alias("_at"), F.col("_c").alias("_s"), F.lit(0).alias("_k"), F.lit(None).cast("double").alias("fetched"))
    changes = changes.select("*", F.lit(1).alias("_k"), F.lit(None).cast("double").alias("fetched"))
    moments = asked.select("entry_key", "_b", F.col("fetched").cast("double").alias("_at"), F.lit(None).cast(kind).alias("_s"), F.lit(2).alias("_k"), F.col("fetched").cast("double").alias("fetched"))
    inside = Window.partitionBy("entry_key", "_b").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = carried.unionByName(changes).unionByName(moments).withColumn("span", F.last("_s", True).over(inside))
    return found.where("_k = 2 and span is not null and (span.until is null or fetched < span.until)").select("entry_key", "fetched", "span")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, width: int = BUCKET) -> DataFrame:
    """capture_id, host, fetched, entry_key, since, until, verdict: one row per capture. Times are numbers."""
    rows = captures.select(F.col(id_col).alias("capture_id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched"))
    spans = intervals(entries)
    # keys with any entry are few; a host's keys are a handful
    hosts = rows.select("host").where("host is not null").distinct().select("host", F.posexplode(keys_of(F.col("host"))).alias("depth", "entry_key"))
    listed = hosts.join(spans.select("entry_key").distinct(), "entry_key")
    stamped = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct().join(listed, "host")
    active = as_of(stamped.select("entry_key", "fetched").distinct(), spans, width).withColumnRenamed("fetched", "_at")
    hits = stamped.withColumn("_at", F.col("fetched").cast("double")).join(active, ["entry_key", "_at"])
    best = hits.groupBy("host", "fetched").agg(F.min(F.struct("depth", "entry_key", "span")).alias("hit"))
    out = rows.join(best, ["host", "fetched"], "left")
    return out.select("capture_id", "host", "fetched", "hit.entry_key", "hit.span.since", "hit.span.until", F.coalesce("hit.span.verdict", F.lit("pass")).alias("verdict"))


QUERY = "op1_temporal_url_lists"
#: The tables hold neither fetch days nor lists; both are made from md5 digests, alike in Spark and SQL.
DAYS, CHANGES = 1000, 4
VERDICTS = ("block", "pass", "review")


def digest(text, at: int, modulus: int):
    return F.conv(F.substring(F.md5(text), at, 6), 16, 10).cast("long") % modulus


def sample_entries(pages: DataFrame) -> DataFrame:
    """Changes of the last three labels of every host and of a third of the hosts."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    keys = hosts.where(digest(F.col("host"), 1, 3) == 0).select(F.col("host").alias("entry_key"))
    keys = keys.union(hosts.select(domain.alias("entry_key")).where("entry_key <> ''")).distinct()
    changes = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(CHANGES - 1))))
    seed = F.concat_ws("#", "entry_key", F.col("k").cast("string"))
    kind = digest(seed, 9, 4)
    table = F.array(*[F.lit(v) for v in VERDICTS])
    return changes.select("entry_key", digest(seed, 1, DAYS).cast("int").alias("at"), F.when(kind < 3, F.get(table, kind.cast("int"))).alias("verdict"))


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", digest(F.concat(F.lit("fetch"), F.col("page_id").cast("string")), 1, DAYS).cast("int"))
    out = evaluate(captures, sample_entries(pages), "page_id", "url", "fetched")
    return out.withColumnRenamed("capture_id", "page_id")


ORACLE = r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1)), '') AS host,
         CAST(CAST('0x' || substr(md5('fetch' || page_id), 1, 6) AS BIGINT) % 1000 AS INTEGER) AS fetched
  FROM pages
), h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
keys AS (
  SELECT host AS entry_key FROM h WHERE CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) % 3 = 0
  UNION
  SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM h WHERE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''
), changes AS (
  SELECT entry_key, CAST(CAST('0x' || substr(md5(entry_key || '#' || k), 1, 6) AS BIGINT) % 1000 AS INTEGER) AS moment,
         CASE CAST('0x' || substr(md5(entry_key || '#' || k), 9, 6) AS BIGINT) % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'pass' WHEN 2 THEN 'review' END AS verdict
  FROM keys, range(4) r(k)
), newest AS (SELECT entry_key, moment, max(verdict) AS verdict FROM changes GROUP BY entry_key, moment),
spans AS (SELECT entry_key, verdict, moment AS since, lead(moment) OVER (PARTITION BY entry_key ORDER BY moment) AS until FROM newest),
hits AS (
  SELECT p.page_id, s.entry_key, s.since, s.until, s.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.entry_key) DESC) AS rn
  FROM p JOIN spans s ON (p.host = s.entry_key OR (ends_with(p.host, '.' || s.entry_key) AND NOT regexp_matches(p.host, '^(\d{1,3}(\.\d{1,3}){3}|\[.*)$')))
  WHERE s.verdict IS NOT NULL AND s.since <= p.fetched AND (s.until IS NULL OR p.fetched < s.until)
)
SELECT p.page_id, p.host, p.fetched, x.entry_key, x.since, x.until, coalesce(x.verdict, 'pass') AS verdict
FROM p LEFT JOIN hits x ON p.page_id = x.page_id AND x.rn = 1
"""
