"""The driver's contract."""

import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
    assert any(n.startswith("p1_") for n in entry.queries()) == (importlib.util.find_spec("leafmere.llm") is not None)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the test tables are not here")
def test_flagship_and_shipping(spark):
    df = entry.entry(spark)
    assert 0 < df.count() <= 20 and df.columns[0] == "o_orderkey"
    assert any(p.endswith(".zip") and "leafmere-" in p for p in [str(f) for f in spark.sparkContext.listFiles])
