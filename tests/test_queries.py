"""Every query with SQL gives what DuckDB gives."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from geoframe.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"  # smaller tables have no point in a box
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        order = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str)).reset_index(drop=True)
        pd.testing.assert_frame_equal(order(got).map(lambda v: float(v) if isinstance(v, (int, float)) else v), order(want).map(lambda v: float(v) if isinstance(v, (int, float)) else v), check_dtype=False)


def test_bezier_spline_whole(spark):
    got = QUERIES["bezier_spline"](spark, DATA).toPandas()
    assert sorted(got.id) == sorted(pd.read_parquet(f"{DATA}/customer.parquet").c_custkey) and set(got.positions) == {501}
