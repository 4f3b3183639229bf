"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same check at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import canon, same_type
from tokenledger.plans.catalog import ORACLE, QUERIES
from tokenledger.sources.tables import TABLES

SF = os.environ.get("TOKENLEDGER_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.execute(E.oracle_sql()[name])
    c1, r1 = canon(df.columns, [tuple(r) for r in df.collect()])
    c2, r2 = canon([d[0] for d in rel.description], rel.fetchall())
    assert c1 == c2
    assert r1 == r2
    typed = con.sql(E.oracle_sql()[name])
    duck = dict(zip(typed.columns, map(str, typed.types)))
    mismatched = [(f.name, f.dataType.simpleString(), duck[f.name]) for f in df.schema.fields
                  if not same_type(f.dataType.simpleString(), duck[f.name])]
    assert not mismatched


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total_cost_usd" in df.columns
