"""Plan-shape checks on the sf0.001 tables: the properties the scale design
relies on must show in the physical plan Catalyst picks."""

import os

import pytest

import __spark_entry__ as E

SF = os.environ.get("TOKENLEDGER_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def plan(spark):
    qs = E.queries()

    def get(name):
        return qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    return get


def test_rollup_combines_before_the_shuffle(plan):
    p = plan("usage_rollup")
    assert "partial_sum" in p and "partial_count" in p
    assert p.index("partial_sum") > p.index("Exchange hashpartitioning")    # partial agg sits below the exchange


def test_date_range_reaches_the_scan(plan):
    for name in ("usage_range", "cache_hit_rate"):
        p = plan(name)
        assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p, name


def test_scan_reads_only_used_columns(plan):
    p = plan("latency_by_model")
    schema = p[p.index("ReadSchema: struct<"):].split(">")[0]
    # latency needs provider, model and latency only: ts, user_id and props are pruned
    assert schema == "ReadSchema: struct<event_id:bigint,event_type:string,value:double"
    p = plan("sanitize_log")
    schema = p[p.index("ReadSchema: struct<"):].split(">")[0]
    assert schema == "ReadSchema: struct<doc_id:bigint,text:string"  # lang, source, n_chars pruned


def test_shipped_index_scores_queries_without_a_shuffle(plan):
    p = plan("semantic_match")
    assert "MapInArrow" in p and "SortMergeJoin" not in p and "CartesianProduct" not in p
    # the prompts reach the scoring pass through the broadcast neighbour join only
    assert p.count("Exchange hashpartitioning") == 0


def test_no_cartesian_products(plan):
    for name in E.queries():
        if name.startswith("stream_"):
            continue
        p = plan(name)
        assert "CartesianProduct" not in p, name
