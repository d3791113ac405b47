"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from quarry.plans import catalog
from tests.compare import frames_equal
from tests.conftest import SMALL

catalog.load_all()
ORACLE, QUERIES = dict(catalog.ORACLE), dict(catalog.QUERIES)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"region", "product", "avg_risk_score"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    problem = frames_equal(got, want)
    assert problem is None, f"{name}: {problem}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
    p_values = [c for c in df.columns if c.endswith("_p") or c == "p_value"]
    assert all(0 <= r[c] <= 1 for r in rows for c in p_values if r[c] is not None)
