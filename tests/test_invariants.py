"""Invariants over the registered queries on the sf0.001 tables:
merge = full rollup, drift of a rollup against itself is empty, admitted +
rejected = ingested, hits + misses = total, audit rows = non-502 outcomes +
cache hits, and each stream equals its batch twin."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tokenledger.operators import rollup as R
from tokenledger.plans import fixtures as FX
from tokenledger.sources.tables import read_table

SF = os.environ.get("TOKENLEDGER_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def q():
    return E.queries()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_equals_full_rollup(spark, q):
    full = q["usage_rollup"](spark, SF)
    assert _rows(q["usage_merge"](spark, SF).select(*full.columns)) == _rows(full)
    audit = FX.audit_from_events(read_table(spark, SF, "events"))
    assert R.rollup_drift(audit, R.usage_rollup(audit)).count() == 0


def test_admission_accounts_for_every_request(spark, q):
    out = q["admission"](spark, SF)
    n_conv = read_table(spark, SF, "conversations").select("conv_id").distinct().count()
    by_status = {r["status"]: r["count"] for r in out.groupBy("status").count().collect()}
    assert sum(by_status.values()) == n_conv and set(by_status) <= {200, 400, 429, 501}
    assert out.filter((F.col("status") == 200) != F.col("reason").isNull()).count() == 0


def test_hits_plus_misses(spark, q):
    out = q["semantic_lookup"](spark, SF)
    n = read_table(spark, SF, "embeddings").count()
    hits = out.filter("hit").count()
    assert out.count() == n and 0 < hits < n
    assert out.filter("hit AND served_id IS NULL").count() == 0


def test_audit_rows_partition_outcomes(spark, q):
    outcomes = q["attempt_outcomes"](spark, SF)
    views = read_table(spark, SF, "events").filter("event_type = 'view'").count()
    assert q["audit_rows"](spark, SF).count() == outcomes.filter("outcome <> 'rejected_502'").count() + views


@pytest.mark.parametrize("stream,batch", [("stream_rate_limit", "rate_limit"), ("stream_admission", "admission"),
                                          ("stream_usage", "usage_rollup")])
def test_stream_equals_batch(spark, q, stream, batch):
    s = q[stream](spark, SF)
    b = q[batch](spark, SF).select(*s.columns)
    assert _rows(s) == _rows(b)
