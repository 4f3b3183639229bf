"""The queries that SQL can express against their DuckDB SQL, on the sf0.001 tables."""

import duckdb
import pytest

from scripts.check_oracle import canon, same_type
from tokenledger.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())
    duck = dict(zip(rel.columns, map(str, rel.types)))
    assert all(same_type(f.dataType.simpleString(), duck[f.name]) for f in df.schema.fields)


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
