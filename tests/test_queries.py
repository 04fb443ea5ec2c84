"""Every registered catalogue query with SQL gives the same rows in DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from fundsieve.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = pytest.importorskip("duckdb").connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_has_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


def test_the_entry_point_runs(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
