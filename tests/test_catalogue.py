"""Every registered query of the engine against DuckDB."""

import math

import duckdb
import pytest

from sparkrel.plans import catalogue


def norm(rows):
    return sorted(([(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x) for x in r] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, small, duck, name):
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert norm(map(tuple, got.select(*names).collect())) == norm(want.fetchall())
