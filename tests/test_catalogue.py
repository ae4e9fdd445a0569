"""Every query of the core against its SQL over the smallest test tables."""

import math
from pathlib import Path

import pytest

from leafmere.plans import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    if name in catalogue.oracle_sql():
        cursor = duck.execute(catalogue.oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=repr)
