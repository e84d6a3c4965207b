"""Archive queries over customers whose place lies beyond the rows of zoom 14."""

import duckdb
import pytest

from geoframe.plans import families  # noqa: F401
from geoframe.plans.queries import QUERIES, SQL

FAR = 128 * (1 << 14)  # the first customer without a row in zoom 14


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """A folder with few customers, near and far, and orders of these and of others; and a connection to it."""
    folder = tmp_path_factory.mktemp("far")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT DISTINCT k::BIGINT AS c_custkey FROM (SELECT unnest([0, 5, 389, 4000, {FAR - 1}, {FAR}, {FAR + 5}, {2 * FAR + 389}, 5399999]) AS k UNION ALL SELECT {FAR} + range FROM range(300))")
    con.execute(f"CREATE TABLE orders AS SELECT (row_number() OVER ())::BIGINT AS o_orderkey, k::BIGINT AS o_custkey FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT {FAR} + range * 37 FROM range(200) UNION ALL SELECT {130 * FAR} + range FROM range(9))")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["archive_directory", "archive_metadata", "archive_tiles", "archive_tile", "archive_header", "archive_batch", "archive_codec", "archive_contains"])
def test_far_places(spark, far, name):
    folder, con = far
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    rows = lambda df: sorted(str([None if v is None or v != v else v if isinstance(v, str) else int(v) for v in r]) for r in df[sorted(want.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
