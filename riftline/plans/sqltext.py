"""Pieces of the SQL that the registered queries are held against."""

from __future__ import annotations

SER = """ser AS (
  SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t,
         value AS x, count(*) OVER (PARTITION BY event_type) AS n FROM events)"""


def stat(w: int, source: str = "ser", key: str = "series_id", name: str = "stat") -> str:
    over = f"OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN"
    return f"""{name} AS (
  SELECT {key}, t, x, n, CASE WHEN t >= {w} AND t < n - {w} THEN round(sqrt(list_sum(list_transform(
           list_zip(list_sort(l), list_sort(r)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / {w}), 9) ELSE 0.0::DOUBLE END AS g
  FROM (SELECT *, list(x) {over} {w} PRECEDING AND 1 PRECEDING) AS l,
               list(x) {over} CURRENT ROW AND {w - 1} FOLLOWING) AS r FROM {source}))"""


GRAD = """grad AS (
  SELECT *, CASE WHEN n = 1 THEN 0.0::DOUBLE WHEN t = 0 THEN lead(g) OVER o - g WHEN t = n - 1 THEN g - lag(g) OVER o
            ELSE (lead(g) OVER o - lag(g) OVER o) / 2 END AS grad
  FROM stat WINDOW o AS (PARTITION BY series_id ORDER BY t))"""


def cuts(levels) -> str:
    return "cut AS (" + " UNION ALL ".join(f"SELECT series_id, {q}::DOUBLE AS q, round(quantile_cont(g, {q}), 9) AS cutoff FROM stat GROUP BY series_id" for q in levels) + ")"


CAND = """isl AS (
  SELECT grad.*, q, t - row_number() OVER (PARTITION BY grad.series_id, q ORDER BY t) AS island
  FROM grad JOIN cut ON grad.series_id = cut.series_id WHERE g > cutoff
), runs AS (
  SELECT series_id, q, island, min(t) AS run, max(t) AS run_end, count(*) AS size, max(island) OVER (PARTITION BY series_id, q) AS last_island
  FROM isl GROUP BY series_id, q, island
), cand AS (
  SELECT isl.*, run, run_end FROM isl JOIN runs USING (series_id, q, island) WHERE size >= 2 AND island < last_island)"""

ENDS = """SELECT s.series_id, q, t FROM cut c JOIN (
    SELECT series_id, 0 AS t FROM stat UNION SELECT series_id, n - 1 FROM stat) s ON s.series_id = c.series_id"""

EDGES = {
    "gradient": "SELECT series_id, q, unnest([arg_min(t, (grad, t)), arg_max(t, (grad, -t))]) AS t FROM cand WHERE t < run_end GROUP BY series_id, q, run",
    "run_edge": "SELECT series_id, q, unnest([min(t), max(t)]) AS t FROM cand GROUP BY series_id, q, run",
    "half_max": """SELECT series_id, q, unnest([min(t), max(t)]) AS t FROM (
      SELECT *, (min(g) OVER (PARTITION BY series_id, q, run) + max(g) OVER (PARTITION BY series_id, q, run)) / 2 AS half FROM cand WHERE t < run_end)
      WHERE g >= half GROUP BY series_id, q, run""",
    "peak": "SELECT series_id, q, arg_max(t, (g, -t)) AS t FROM cand WHERE t < run_end GROUP BY series_id, q, run",
}


def mean_stat(w: int) -> str:
    over = "OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN"
    return f"""stat AS (SELECT series_id, t, x, n, CASE WHEN t >= {w} AND t < n - {w} THEN round(abs(
      avg(x) {over} CURRENT ROW AND {w - 1} FOLLOWING) - avg(x) {over} {w} PRECEDING AND 1 PRECEDING)), 9) ELSE 0.0::DOUBLE END AS g FROM ser)"""


def points(w: int, levels, rule: str = "gradient", source: str = "") -> str:
    """CTEs up to ``cps`` (series_id, q, t); ``source``: the statistic's CTE, if it isn't W2."""
    ends = "" if rule == "peak" else f" UNION {ENDS}"
    return f"{SER}, {source or stat(w)}, {GRAD}, {cuts(levels)}, {CAND}, cps AS (SELECT DISTINCT series_id, q, CAST(t AS BIGINT) AS t FROM ({EDGES[rule]}{ends}))"


def segs(w: int, level: float, append_end: bool = False) -> str:
    """CTEs up to ``seg`` (series_id, q, seg, start, end_)."""
    more = ", all_cps AS (SELECT * FROM cps" + (" UNION SELECT DISTINCT cps.series_id, q, n FROM cps JOIN ser ON cps.series_id = ser.series_id" if append_end else "") + ")"
    return points(w, [level]) + more + """, seg AS (
  SELECT series_id, q, row_number() OVER o - 1 AS seg, t AS start, lead(t) OVER o AS end_ FROM all_cps
  WINDOW o AS (PARTITION BY series_id, q ORDER BY t) QUALIFY end_ IS NOT NULL),
mem AS (SELECT ser.series_id, q, seg, start, end_, t, x, n FROM ser JOIN seg ON ser.series_id = seg.series_id AND t >= start AND t < end_)"""


def profile(v: str, levels: int) -> str:
    return f"""list_transform(range({levels}), lambda k: {v}[CAST(floor(least(greatest((k + 0.5) / {levels}.0::DOUBLE * len({v}) - 0.5, 0), len({v}) - 1)) AS INTEGER) + 1]
  + (least(greatest((k + 0.5) / {levels}.0::DOUBLE * len({v}) - 0.5, 0), len({v}) - 1) - floor(least(greatest((k + 0.5) / {levels}.0::DOUBLE * len({v}) - 0.5, 0), len({v}) - 1)))
  * ({v}[least(CAST(floor(least(greatest((k + 0.5) / {levels}.0::DOUBLE * len({v}) - 0.5, 0), len({v}) - 1)) AS INTEGER) + 2, len({v}))]
   - {v}[CAST(floor(least(greatest((k + 0.5) / {levels}.0::DOUBLE * len({v}) - 0.5, 0), len({v}) - 1)) AS INTEGER) + 1]))"""


def gap(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def uniform(text: str, modulus: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) % {modulus})"


def greedy(lists: str, keys: str) -> str:
    """CTEs up to ``hits`` (keys, tau, np, nc, m): on a line, pairing from the left and dropping what is too far behind matches most."""
    return f"""st AS (SELECT {keys}, tau, p, c, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS m FROM {lists}
      UNION ALL SELECT {keys}, tau, p, c, CASE WHEN c[j] < p[i] - tau THEN i ELSE i + 1 END, CASE WHEN p[i] < c[j] - tau THEN j ELSE j + 1 END, m + CAST(abs(p[i] - c[j]) <= tau AS BIGINT)
      FROM st WHERE i <= len(p) AND j <= len(c)),
    hits AS (SELECT {keys}, tau, any_value(len(p)) AS np, any_value(len(c)) AS nc, max(m) AS m FROM st GROUP BY {keys}, tau)"""


def curve(points_sql: str, truth: str, taus, keys: str = "series_id") -> str:
    """The whole SQL of a tolerance curve: ``points_sql`` are CTEs up to ``pts`` (keys, t), ``truth`` a CTE truth (series_id, truth)."""
    key = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE {points_sql}, {truth}, taus AS (SELECT unnest({list(taus)}) AS tau), lists AS (SELECT {key}, tau, p, c
      FROM (SELECT {keys}, list(t ORDER BY t) AS p FROM pts GROUP BY ALL) a JOIN (SELECT series_id, list(truth ORDER BY truth) AS c FROM truth GROUP BY 1) b ON a.series_id = b.series_id, taus), {greedy("lists", keys)},
    s AS (SELECT *, m::DOUBLE / np AS p, m::DOUBLE / nc AS r FROM hits)
    SELECT {keys}, CAST(tau AS BIGINT) AS tau, CAST(np AS BIGINT) AS n_predicted, CAST(nc AS BIGINT) AS n_true, m AS n_matched, round(p, 6) AS "precision", round(r, 6) AS recall,
      round(CASE WHEN m > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s"""
