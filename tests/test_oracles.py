"""Every query with SQL against DuckDB, and every other one for a result, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from vigilark.plans import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
#: Each of these trains or draws anew and takes a while; they have tests of their own.
SLOW = {
    "nsg_vectors", "ntx_vectors", "nsg_losses", "classifier_scores", "classifier_sampled_split", "classifier_plain_reference", "classifier_stored",
    "classifier_progress", "validity_summary",
}


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        if isinstance(x, (str, bool)):
            return x
        if hasattr(x, "__len__"):
            return [plain(y) for y in x]
        return round(float(x), 5) + 0.0

    return sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-5)), (x, y)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
