"""Queries on training text with SQL give the same rows in DuckDB; the others run, over whole tables of the smallest data."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from lattica.llm import registry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df, rel = registry.queries()[name](spark, str(DATA)), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_every_query_runs(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        registry.queries()[name](spark, str(DATA)).count()
