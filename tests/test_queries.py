"""Registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from riftline.plans import catalog, compositions, connectors, evaluations, reports  # noqa: F401  these register their queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(frame, columns):
    def show(v):
        if v is None or v != v or str(v) == "<NA>":
            return "null"
        return f"{float(v):.4f}" if isinstance(v, float) and math.isfinite(v) else str(v)

    return sorted(tuple(map(show, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


#: Grids of many settings and long kernels, of operators that have tests of their own.
LONG = {"block_null_grid", "copula_flip_run", "correlation_flip_run", "cutoffs_by_rule", "grid_scores", "imbalanced_run", "resampling_grid", "sinkhorn_derivative", "three_rules", "variance_sweep", "window_grid"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - LONG))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_three_rules_run_all_replicates(spark, monkeypatch):
    seen = {}

    def spy(name, make):
        def counted(series, count, *args):
            seen[name] = count
            return make(series, count, *args)

        return counted

    for name in ("permuted", "block_bootstrap"):
        monkeypatch.setattr(catalog.N, name, spy(name, getattr(catalog.N, name)))
    catalog.QUERIES["three_rules"](spark, DATA)
    assert seen == {"permuted": 199, "block_bootstrap": 199}
