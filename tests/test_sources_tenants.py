"""Edge tables: request ingest (S1, S2), tenant lookup and tool scoping (J1,
P10, S3), seed-if-absent and defaults (S6, S7), KV write encoding (S9)."""

import datetime as dt

from pyspark.sql import functions as F

from tokenledger.operators.tenants import conform_tenants, scope_tools, seed_if_absent, with_tenant_config
from tokenledger.sources.kv import kv_latest_live, kv_write
from tokenledger.sources.requests import ingest_requests, split_valid

RAW = "request_id long, body string, headers map<string,string>"


def test_ingest_defaults_and_quarantine(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "hi"}]}', {"X-Tenant-ID": "acme"}),
        (2, '{"model": "claude-3-opus-20240229", "messages": [], "stream": true}', {"x-tenant-id": ""}),
        (3, '{"messages": [{"content": "no role"}]}', {}),                  # missing role -> quarantine
        (4, '{"model": "gpt-4o"}', None),                                  # no messages -> quarantine
        (5, 'not json', {"X-TENANT-ID": "t5"}),
        (6, '{"messages": []}', {"X-Tenant-ID": "first", "x-tenant-id": "second"}),   # no duplicate-key error
        (7, '{"model": null, "messages": []}', {}),                       # explicit null: rejected
    ]
    got = {r["request_id"]: r for r in ingest_requests(spark.createDataFrame(rows, RAW)).collect()}
    assert got[1]["model"] == "gpt-4" and got[1]["stream"] is False and got[1]["tenant_id"] == "acme"
    assert got[2]["tenant_id"] == "" and got[2]["stream"] is True and got[2]["valid"]   # empty header stays empty
    assert got[3]["tenant_id"] == "default" and not got[3]["valid"]
    assert got[4]["tenant_id"] == "default" and not got[4]["valid"]
    assert got[5]["tenant_id"] == "t5" and not got[5]["valid"] and got[5]["raw_body"] == "not json"
    assert got[6]["tenant_id"] in ("first", "second") and got[6]["valid"]
    ok, bad = split_valid(ingest_requests(spark.createDataFrame(rows, RAW)))
    assert sorted(r["request_id"] for r in ok.collect()) == [1, 2, 6]
    assert sorted(r["request_id"] for r in bad.collect()) == [3, 4, 5, 7]


def test_ingest_checks_types_and_reads_numbers_leniently(spark):
    m = '"messages": [{"role": "user", "content": "hi"}]'
    bad = ['{"messages": [{"role": 7}]}', '{"messages": [{"role": "user", "content": [1]}]}', '{"messages": "x"}',
           '{"messages": [{"role": "user", "content": 5}]}', '{"messages": [3]}', '{"messages": [null]}', "[]", "null", None,
           f'{{{m}, "model": 3}}', f'{{{m}, "tools": "zz"}}', f'{{{m}, "tools": [1]}}', f'{{{m}, "max_tokens": "abc"}}',
           f'{{{m}, "max_tokens": 5.5}}', f'{{{m}, "max_tokens": []}}', f'{{{m}, "stream": "maybe"}}', f'{{{m}, "stream": 2}}',
           f'{{{m}, "stream": null}}', f'{{{m}, "temperature": "warm"}}', f'{{{m}, "tool_choice": 1}}',
           '{"messages": [{"role": "user", "name": 1}]}']
    good = [(f'{{{m}, "max_tokens": 5.0, "stream": 1}}', 5, True, None), (f'{{{m}, "max_tokens": " 7 "}}', 7, False, None),
            (f'{{{m}, "max_tokens": null, "stream": "OFF", "temperature": "1e-1"}}', None, False, 0.1),
            (f'{{{m}, "max_tokens": 3000000000, "stream": "Yes", "temperature": 2}}', 3_000_000_000, True, 2.0),
            (f'{{{m}, "tools": [{{"a": 1}}], "tool_choice": "auto", "stream": false}}', None, False, None)]
    rows = [(i, b, None) for i, b in enumerate([*bad, *[g[0] for g in good]])]
    out = {r["request_id"]: r for r in ingest_requests(spark.createDataFrame(rows, RAW)).collect()}
    assert len(out) == len(rows) and not any(out[i]["valid"] for i in range(len(bad)))
    for i, (_, tokens, stream, temperature) in enumerate(good, len(bad)):
        assert (out[i]["valid"], out[i]["max_tokens"], out[i]["stream"], out[i]["temperature"]) == (
            True, tokens, stream, temperature)
    assert out[len(rows) - 1]["tools"] == '[{"a":1}]' and out[len(rows) - 1]["tool_choice"] == "auto"


def test_tool_scoping_and_limits(spark):
    cfg = spark.createDataFrame([("yes", 5, True, None), ("no", None, False, None), ("null", 0, None, None)],
                                "tenant_id string, rate_limit_rpm int, allow_tool_calls boolean, "
                                "system_prompt_override string")
    req = spark.createDataFrame([(1, "yes", "t"), (2, "no", "t"), (3, "null", "t"), (4, "absent", "t")],
                                "request_id long, tenant_id string, tools string")
    j = with_tenant_config(req, cfg)
    got = {r["request_id"]: (r["cfg_present"], r["limit_rpm"], r["t"])
           for r in j.select("*", scope_tools().alias("t")).collect()}
    # absent config keeps tools; a null flag strips them; a null limit reads as 60
    assert got == {1: (True, 5, "t"), 2: (True, 60, None), 3: (True, 0, None), 4: (False, 60, "t")}


def test_seed_if_absent_and_defaults(spark):
    existing = conform_tenants(spark.createDataFrame([("default", 7)], "tenant_id string, rate_limit_rpm int"))
    seed = spark.createDataFrame([("default",), ("new",)], "tenant_id string")
    out = {r["tenant_id"]: r for r in seed_if_absent(existing, seed).collect()}
    assert out["default"]["rate_limit_rpm"] == 7                      # ON CONFLICT DO NOTHING
    assert out["new"]["rate_limit_rpm"] == 60 and out["new"]["allow_tool_calls"] is True
    assert len(out["new"]["allowed_models"]) == 5 and out["new"]["system_prompt_override"] is None


def test_kv_write_json_roundtrip(spark):
    t0 = dt.datetime(2024, 1, 1)
    w = spark.createDataFrame([("a", 1, t0)], "key string, n int, written_at timestamp") \
             .select("key", F.struct(F.col("n").alias("k")).alias("value"), "written_at")
    out = kv_latest_live(kv_write(None, w, encode_json=True, ttl_s=60), t0 + dt.timedelta(seconds=59)).first()
    assert out["raw"] is None and out["json"] is not None
    assert kv_latest_live(kv_write(None, w, encode_json=True, ttl_s=60), t0 + dt.timedelta(seconds=60)).count() == 0


def test_broadcast_counts_measured_bytes(spark):
    from tokenledger.operators.dimensions import fits_broadcast
    small = spark.createDataFrame([(f"t{i}", "x" * 10) for i in range(50)], "tenant_id string, system_prompt_override string")
    long = spark.createDataFrame([(f"t{i}", "x" * 10_000) for i in range(50)], small.schema)
    assert fits_broadcast(small, max_bytes=100_000) and not fits_broadcast(long, max_bytes=100_000)
    assert not fits_broadcast(small, max_rows=49) and fits_broadcast(small.limit(0))


def test_long_prompts_force_no_broadcast(spark, monkeypatch):
    from tokenledger.operators import dimensions
    cfg = spark.range(200).select(F.concat(F.lit("t"), "id").alias("tenant_id"), F.lit(5).alias("rate_limit_rpm"),
                                  F.lit(True).alias("allow_tool_calls"), F.repeat(F.lit("x"), 1000).alias("system_prompt_override"))
    req = spark.createDataFrame([(1, "t1")], "request_id long, tenant_id string")

    def hinted():
        return "strategy=broadcast" in with_tenant_config(req, cfg)._jdf.queryExecution().analyzed().toString()

    assert hinted()
    monkeypatch.setattr(dimensions.fits_broadcast, "__defaults__", (1_000_000, 100_000))
    assert not hinted() and with_tenant_config(req, cfg).first()["rate_limit_rpm"] == 5


def test_conform_fills_omitted_columns_only(spark):
    from tokenledger.operators.tenants import AUDIT_DEFAULTS, TENANT_DEFAULTS, USAGE_DEFAULTS, conform
    audit = conform(spark.createDataFrame([("t", None)], "tenant_id string, latency_ms int"), AUDIT_DEFAULTS).first()
    assert audit["cache_hit"] is False and audit["created_at"] is not None and audit["latency_ms"] is None
    usage = conform(spark.createDataFrame([("t", None)], "tenant_id string, errors long"), USAGE_DEFAULTS).first()
    assert usage["total_requests"] == 0 and usage["total_cost_usd"] == 0 and usage["errors"] is None    # null stays
    tenant = conform(spark.createDataFrame([("t",)], "tenant_id string"), TENANT_DEFAULTS).first()
    assert tenant["rate_limit_rpm"] == 60 and len(tenant["allowed_models"]) == 5 and tenant["updated_at"] is not None


def test_milliseconds_are_cut_toward_zero(spark):
    from tokenledger.functions.timeutil import millis
    rows = spark.createDataFrame([(1.2349,), (0.0009,), (-0.0019,), (None,)], "s double")
    assert [r[0] for r in rows.select(millis("s")).collect()] == [1234, 0, -1, None]


def test_dashboard_row_order(spark):
    """The order itself, not only the rows."""
    from tokenledger.operators import dashboard as D
    from tokenledger.operators import rollup as R
    days = [dt.date(2024, 1, d) for d in (3, 9, 5)]
    keys = [(t, d, p) for t in ("b", "a") for d in days for p in ("y", "x")]
    usage = spark.createDataFrame([(*k, 1, 1, 1, 0, 0, 0) for k in keys], "tenant_id string, date date, provider string, "
                                  + ", ".join(f"{c} long" for c in R.COUNTERS)).repartition(5)
    got = [(r["date"], r["tenant_id"], r["provider"]) for r in D.usage_range(usage, "2024-01-09").collect()]
    assert got == sorted(got, key=lambda r: (-r[0].toordinal(), r[1], r[2])) and len(got) == 12
    one = [(r["date"], r["provider"]) for r in D.usage_range(usage, "2024-01-09", tenant_id="a").collect()]
    assert one == sorted(one, key=lambda r: (-r[0].toordinal(), r[1])) and len(one) == 6
    audit = spark.createDataFrame([("t", p, m, 5, "x") for p in ("q", "p") for m in ("n", "m", "o")],
                                  "tenant_id string, provider string, model string, latency_ms int, error_message string")
    for report in (D.latency, D.errors):
        rows = [(r["provider"], r["model"]) for r in report(audit.repartition(4)).collect()]
        assert rows == sorted(rows) and len(rows) == 6
        assert [(r["provider"], r["model"]) for r in report(audit.repartition(4), limit=4).collect()] == rows[:4]


def test_request_files_are_sorted_out_in_one_pass(spark):
    import json
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources.requests import (read_request_files, read_requests, stream_request_files, stream_requests_sink,
                                              write_requests)
    base = scratch_path(spark, f"test_request_files/{uuid.uuid4().hex}")
    good = {"messages": [{"role": "user", "content": "hi"}]}
    lines = [json.dumps({"request_id": "a", "ts": "2024-01-01 00:00:00", "headers": {"x-tenant-id": "t1"}, "body": json.dumps(good)}),
             json.dumps({"request_id": "b", "headers": {}, "body": json.dumps({"messages": "no list"})}),
             json.dumps({"request_id": "c", "body": None}), "no json at all {", "",
             json.dumps({"request_id": "d", "body": json.dumps({**good, "model": "claude-3"}), "more": 1})]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(2).write.text(f"{base}/in")
    write_requests(read_request_files(spark, f"{base}/in"), f"{base}/batch")
    q = stream_requests_sink(stream_request_files(spark, f"{base}/in/*.txt", files_per_trigger=1), f"{base}/stream", f"{base}/_c")
    q.awaitTermination(120)
    for where in ("batch", "stream"):
        ok, bad = read_requests(spark, f"{base}/{where}")
        assert {(r["request_id"], r["tenant_id"], r["model"]) for r in ok.collect()} == {
            ("a", "t1", "gpt-4"), ("d", "default", "claude-3")}
        assert ok.count() + bad.count() == len(lines)
        texts = {r["request_id"]: r["raw_body"] for r in bad.collect()}
        assert texts["b"] == json.dumps({"messages": "no list"}) and "no json at all {" in {r["raw_body"] for r in bad.collect()}


def test_measuring_a_lookup_moves_no_rows(spark):
    """The size is added up from one row a task: no exchange of the dimension's rows, no global limit."""
    from unittest import mock
    from tokenledger.operators import dimensions
    dim = spark.range(1000, numPartitions=8).withColumn("text", F.repeat(F.lit("x"), 50))
    plans = []
    real = type(dim).first
    with mock.patch.object(type(dim), "first", lambda df: plans.append(
            df._jdf.queryExecution().executedPlan().toString()) or real(df)):
        assert dimensions.fits_broadcast(dim)
    assert "Limit" not in plans[0].replace("CollectLimit", "") and "partial_count" in plans[0]
