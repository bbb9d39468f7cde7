"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

from countloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _key(row):
    return tuple((type(x).__name__ if x is None else "", repr(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
    rel = con.execute(catalog.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, rel=1e-6, abs=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
