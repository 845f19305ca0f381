"""Every query with SQL against DuckDB on the small tables, as the driver does."""

import os

import duckdb
import pytest

from rillstone.plans import stateful as catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted((tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    result = db.execute(catalog.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert plain(got) == plain(result.fetchall())
