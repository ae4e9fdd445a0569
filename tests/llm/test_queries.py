"""The queries of the subpackage against their SQL over the smallest test tables, and that the rest does without it."""

import math
from pathlib import Path

import pytest

from leafmere.llm import entry

ROOT = Path(__file__).resolve().parents[2]
SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, str(SF))
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    rows = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()], key=repr)
    if name in entry.oracle_sql():
        c = duckdb.connect()
        for f in SF.glob("*.parquet"):
            c.execute(f"create view {f.stem} as select * from '{f}'")
        cursor = c.execute(entry.oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert rows == sorted([tuple(plain(r[names.index(k)]) for k in sorted(df.columns)) for r in cursor.fetchall()], key=repr)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "leafmere").rglob("*.py"):
        if "llm" not in p.parts:
            assert "leafmere.llm" not in p.read_text()
