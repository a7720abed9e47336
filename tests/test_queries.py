"""Each query of the catalogue against its SQL, over a small set of tables."""

import os

import duckdb
import pytest

from chatloom.plans import catalogue
from chatloom.plans import large as _large  # noqa: F401  adds its queries to the catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v.item() if hasattr(v, "item") else v


def rows(columns, data):
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in by]) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert got.columns
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, data) == rows(names, want.fetchall())
