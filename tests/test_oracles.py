"""Each query with SQL gives the same rows in DuckDB, over whole tables of the smallest data."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from lattica.plans import registry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(tuple(map(plain, r)) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got == want


def test_every_query_runs(spark):
    # These two take minutes even here: test_relaxing.py and test_angles.py run their operators on small tables.
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"relax_converged", "angle_search"}):
        registry.queries()[name](spark, str(DATA)).count()
