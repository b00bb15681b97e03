"""Every telemetry query against its SQL, on the smallest tables unless others are named: whole numbers and texts exactly, others to nine digits."""

import math
import os

import pytest

from wayline.plans import registry

SF = os.environ.get("WAYLINE_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [repr(round(x, 3) + 0.0) if isinstance(x, float) else repr(x) for x in r])


def same(x, y):
    """Equal; numbers that aren't whole up to the last digits of a double."""
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
    return x == y


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    frame = registry.QUERIES[name](spark, SF)
    expected = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(frame.columns)
    got, want = rows_of(frame.columns, frame.collect()), rows_of(names, expected.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)
