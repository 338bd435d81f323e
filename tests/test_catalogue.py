"""Every registered query of the plan tables against its SQL."""

import duckdb
import pytest

from parcelkit.plans import anchors, annotation, catalogue, definitions, evidence, exports, overlays, pages, paths, publishing, records, runs, texts  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events pages documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(repr(x) if x is None else str(float(x)) if type(x).__name__ in ("Decimal", "float") else str(x) for x in row)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, con, name):
    want = con.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert rows and sorted(map(plain, got.select(*want.columns).collect())) == sorted(map(plain, rows))
