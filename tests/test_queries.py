"""Each query of the library against the SQL that states it, on the smallest tables."""

import os

import duckdb
import pytest

from lodestow import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert df.columns
        return
    out = duck.sql(catalogue.SQL[name])
    assert sorted(out.columns) == names
    order = [out.columns.index(c) for c in names]
    expected = sorted((tuple(plain(row[k]) for k in order) for row in out.fetchall()), key=repr)
    assert got == expected


def test_every_query_has_rows(spark):
    assert catalogue.QUERIES["cargo_container_estimate"](spark, DIR).count() > 0
