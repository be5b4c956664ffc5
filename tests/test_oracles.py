"""Differential check: every registered query with an oracle equals its
DuckDB statement on the smallest test tables (the driver repeats this at
sf0.01)."""

import pytest

import __spark_entry__ as entry
from revlens.catalog import REGISTRY
from revlens.verify import compare, duck_connect

from paths import SF_SMALL

QUERIES = entry.queries()
_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name not in ORACLES:
        # the llm queries without SQL have brute-force tests of their own
        assert name not in REGISTRY and df.columns
        return
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg
    # column types agree too (the driver compares schemas)
    rel = con.sql(ORACLES[name])
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: _DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_month", "monthly_revenue"]
    assert df.count() > 0
