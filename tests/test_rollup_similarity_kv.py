"""Edge tables: rollup/dashboard (A1, A3, A4), similarity (V2, W4-W6), KV."""

import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tokenledger.operators import dashboard as D
from tokenledger.operators import rollup as R
from tokenledger.operators.similarity import best_match, lookup_responses, retained_index
from tokenledger.sources.kv import kv_latest_live, kv_write

AUDIT = ("created_at timestamp, tenant_id string, provider string, model string, prompt_tokens int, "
         "completion_tokens int, latency_ms int, cost_usd decimal(12,6), cache_hit boolean, error_message string")
T0 = dt.datetime(2024, 1, 10, 12)


def test_rollup_error_rules(spark):
    rows = [(T0, "t", "openai", "gpt-4", 1, 2, 5, None, False, ""),
            (T0, "t", "openai", "gpt-4", 1, 2, 5, Decimal("0.5"), False, "boom")]
    audit = spark.createDataFrame(rows, AUDIT)
    u = R.usage_rollup(audit).first()
    assert (u["total_requests"], u["errors"], u["total_cost_usd"]) == (2, 1, Decimal("0.500000"))
    e = D.errors(audit).first()
    assert e["error_count"] == 2          # dashboard counts the empty-string error


def test_cache_stats_empty(spark):
    audit = spark.createDataFrame([], AUDIT)
    r = D.cache_stats(audit, dt.date(2024, 1, 30)).first()
    assert (r["cache_hits"], r["total_requests"], r["hit_rate_pct"]) == (0, 0, 0.0)


def test_merge_keeps_one_sided_keys(spark):
    rows = [(T0, "t", "openai", "gpt-4", 1, 2, 5, Decimal("0.1"), False, None)]
    a = R.usage_rollup(spark.createDataFrame(rows, AUDIT))
    b = R.usage_rollup(spark.createDataFrame([(T0 + dt.timedelta(days=1),) + rows[0][1:]], AUDIT))
    m = R.merge_rollup(a, b)
    assert m.count() == 2 and R.rollup_drift(spark.createDataFrame(rows, AUDIT), a).count() == 0


def _unit(v):
    v = np.asarray(v, dtype=float)
    return (v / np.linalg.norm(v)).tolist()


def test_best_match_edges(spark):
    e0 = _unit([1, 0, 0])
    # an entry at cosine exactly 0.95 with e0 (within float rounding) and a duplicate of e0 (tie)
    e95 = [0.95, float(np.sqrt(1 - 0.95 ** 2)), 0.0]
    idx = spark.createDataFrame([("r0", 0, e0, T0), ("r1", 1, None, T0), ("r2", 2, [], T0), ("r3", 3, e0, T0),
                                 ("r4", 4, e95, T0)],
                                "response_id string, seq long, embedding array<double>, inserted_at timestamp")
    q = spark.createDataFrame([(1, e0), (2, _unit([0, 0, 1])), (3, None)], "query_id long, embedding array<double>")
    got = {r["query_id"]: r["response_id"] for r in best_match(q, idx).collect()}
    assert got == {1: "r0", 2: None, 3: None}     # tie keeps the earliest entry
    empty = idx.filter("false")
    assert {r["response_id"] for r in best_match(q, empty).collect()} == {None}


def test_best_expired_is_miss(spark):
    m = spark.createDataFrame([(1, "r0"), (2, "r1")], "query_id long, response_id string")
    resp = spark.createDataFrame([("r0", "{}", T0), ("r1", "{}", T0 + dt.timedelta(minutes=30))],
                                 "response_id string, value string, written_at timestamp")
    got = {r["query_id"]: r["hit"] for r in lookup_responses(m, resp, T0 + dt.timedelta(hours=1)).collect()}
    assert got == {1: False, 2: True}             # exactly one hour old: expired


def test_retention(spark):
    rows = [(f"r{i}", i, [1.0, 0.0], T0 + dt.timedelta(seconds=i)) for i in range(501)]
    idx = spark.createDataFrame(rows, "response_id string, seq long, embedding array<double>, inserted_at timestamp")
    kept = retained_index(idx, T0 + dt.timedelta(hours=1))
    assert kept.count() == 500 and kept.agg(F.min("seq")).first()[0] == 1
    assert retained_index(idx, T0 + dt.timedelta(days=8)).count() == 0       # whole index expired
    later = idx.unionByName(spark.createDataFrame([("x", 900, [0.0, 1.0], T0 + dt.timedelta(days=9))], idx.schema))
    assert [r["seq"] for r in retained_index(later, T0 + dt.timedelta(days=9, hours=1)).collect()] == [900]


def test_kv_latest_live(spark):
    w = spark.createDataFrame([("a", '{"k": 1}', T0, 3600), ("a", "not json", T0 + dt.timedelta(minutes=1), 3600),
                               ("b", '{"k": 2}', T0, 60)],
                              "key string, value string, written_at timestamp, ttl_seconds int")
    out = {r["key"]: r for r in kv_latest_live(kv_write(None, w), T0 + dt.timedelta(minutes=5)).collect()}
    assert set(out) == {"a"} and out["a"]["raw"] == "not json" and out["a"]["json"] is None


def test_drift_counts_multiplicity(spark):
    rows = [(T0, "t", "openai", "gpt-4", 1, 2, 5, Decimal("0.1"), False, None),
            (T0, "u", "openai", "gpt-4", 1, 2, 5, Decimal("0.1"), False, None)]
    audit = spark.createDataFrame(rows, AUDIT)
    good = R.usage_rollup(audit)
    t_row = good.filter("tenant_id = 't'")
    wrong = t_row.withColumn("errors", F.lit(9).cast("bigint"))
    stored = t_row.unionByName(t_row).unionByName(wrong)          # t twice, a wrong t row, u missing
    got = sorted((r["tenant_id"], r["side"], r["errors"]) for r in R.rollup_drift(audit, stored).collect())
    assert got == [("t", "stored", 0), ("t", "stored", 9), ("u", "facts", 0)]


def test_partitioned_audit_prunes_dates(spark):
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources.sinks import append_audit
    rows = [(T0 + dt.timedelta(days=d), "t", "cache" if d % 2 else "openai", "gpt-4", 0, 0, None, None,
             bool(d % 2), None) for d in range(10)]
    path = scratch_path(spark, f"test_audit/{uuid.uuid4().hex}")
    append_audit(spark.createDataFrame(rows, AUDIT), path)
    audit = spark.read.parquet(path)
    as_of = (T0 + dt.timedelta(days=9)).date()
    stats = D.cache_stats(audit, as_of, days=3)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date" in plan.split("PartitionFilters")[1]
    r = stats.first()
    assert (r["cache_hits"], r["total_requests"]) == (2, 4)      # days 6..9 of the ten written


def test_upsert_usage_idempotent_per_batch(spark):
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources.sinks import read_usage, upsert_usage
    base = scratch_path(spark, f"test_upsert/{uuid.uuid4().hex}")
    r1 = [(T0, "t", "openai", "gpt-4", 1, 2, 5, Decimal("0.1"), False, None),
          (T0 + dt.timedelta(days=1), "t", "openai", "gpt-4", 3, 4, 5, Decimal("0.2"), False, "x")]
    r2 = [(T0 + dt.timedelta(days=1), "t", "openai", "gpt-4", 10, 0, 5, Decimal("1.0"), True, None)]
    d1 = R.usage_rollup(spark.createDataFrame(r1, AUDIT))
    d2 = R.usage_rollup(spark.createDataFrame(r2, AUDIT))
    upsert_usage(spark, d1, f"{base}/deltas", f"{base}/usage", 0)
    upsert_usage(spark, d1, f"{base}/deltas", f"{base}/usage", 0)       # retried batch: no double count
    upsert_usage(spark, d2, f"{base}/deltas", f"{base}/usage", 1)
    got = _rows_of(read_usage(spark, f"{base}/usage", f"{base}/deltas"))
    want = _rows_of(R.usage_rollup(spark.createDataFrame(r1 + r2, AUDIT)))
    assert got == want and len(got) == 2


def test_upsert_folds_touch_only_their_dates_and_survive_retries(spark):
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources.sinks import read_usage, upsert_usage
    base = scratch_path(spark, f"test_fold/{uuid.uuid4().hex}")
    d, u, rows = f"{base}/deltas", f"{base}/usage", []
    for b in range(7):
        at = None if b in (2, 5) else T0 + dt.timedelta(days=0 if b < 3 else 1)         # null dates too
        batch = [(at, "t", "openai", "gpt-4", b, 1, 5, Decimal("0.5"), b % 2 == 0, None), (at, None, "x", "m", 1, 1, 5, None, False, "")]
        rows += batch
        delta = R.usage_rollup(spark.createDataFrame(batch, AUDIT))
        for _ in range(2 if b in (1, 3) else 1):                                  # a retried fold, a retried delta
            upsert_usage(spark, delta, d, u, b, fold_every=2)
        assert sorted(map(repr, _raw(read_usage(spark, u, d)))) == sorted(
            map(repr, _raw(R.usage_rollup(spark.createDataFrame(rows, AUDIT)))))
    marks = {(r["date"], r["upto"]) for r in spark.read.parquet(u).select("date", "upto").distinct().collect()}
    assert len([m for m in marks if m[0] == T0.date()]) == 1                     # the first date was folded once only


def test_usage_store_does_not_grow_with_its_history(spark):
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources import sinks
    base = scratch_path(spark, f"test_flat/{uuid.uuid4().hex}")
    d, u, rows, sizes = f"{base}/deltas", f"{base}/usage", [], []
    for b in range(12):
        rows.append((T0, "t", "openai", "gpt-4", b, 1, 5, Decimal("0.5"), False, None))
        delta = R.usage_rollup(spark.createDataFrame(rows[-1:], AUDIT))
        for _ in range(2 if b == 7 else 1):
            sinks.upsert_usage(spark, delta, d, u, b, fold_every=2)
        sizes.append([len(sinks._numbered(spark, p, m)) for p, m in ((d, "batch_id"), (u, "upto"), (f"{u}/_manifest", "v"))])
    assert max(n for n, _, _ in sizes) <= 4 and max(n for _, n, _ in sizes) <= 3 and max(n for *_, n in sizes) <= 2
    assert sizes[-1] == sizes[-3] == sizes[-5]                                   # flat, batch after batch
    assert _raw(sinks.read_usage(spark, u, d)) == _raw(R.usage_rollup(spark.createDataFrame(rows, AUDIT)))


def _raw(df):
    return [tuple(r) for r in df.select(*R.KEYS, *R.COUNTERS).collect()]


def _rows_of(df):
    return sorted(tuple(r) for r in df.select(*R.KEYS, *R.COUNTERS).collect())


def test_dashboard_as_of_forms(spark):
    audit = spark.createDataFrame([(T0, "t", "cache", "gpt-4", 0, 0, None, None, True, None)], AUDIT)
    for as_of in ("2024-01-12", "2024-01-12 08:00:00", dt.date(2024, 1, 12), dt.datetime(2024, 1, 12, 8)):
        assert D.cache_stats(audit, as_of, days=7).first()["cache_hits"] == 1


def test_dashboard_parameter_bounds(spark):
    import pytest
    audit = spark.createDataFrame([], AUDIT)
    usage = R.usage_rollup(audit)
    for bad in (0, 91):
        with pytest.raises(ValueError):
            D.usage_range(usage, "2024-01-30", days=bad)
        with pytest.raises(ValueError):
            D.cache_stats(audit, "2024-01-30", days=bad)
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            D.latency(audit, limit=bad)
    for bad in (0, 201):
        with pytest.raises(ValueError):
            D.errors(audit, limit=bad)
    D.usage_range(usage, "2024-01-30", days=90)
    D.latency(audit, limit=1000)
    D.errors(audit, limit=200)


def test_index_oversize_is_rejected(spark):
    import pytest
    rows = [(f"r{i}", i, [1.0, 0.0], T0) for i in range(4)]
    idx = spark.createDataFrame(rows, "response_id string, seq long, embedding array<double>, inserted_at timestamp")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(ValueError):
        best_match(q, idx, max_index_rows=3)           # apply retained_index() first


def test_kv_store_is_compacted_and_purged(spark):
    """Log and snapshot against all writes read at once; retries change nothing; old folders go."""
    import random
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources import folders
    from tokenledger.sources.kv import _table, kv_append, kv_compact, kv_latest_live, kv_table, kv_write
    path, rnd, everything, counts = scratch_path(spark, f"test_kv/{uuid.uuid4().hex}"), random.Random(4), [], []
    t0 = dt.datetime(2024, 1, 1)
    assert kv_table(spark, path).count() == 0
    for b in range(9):
        rows = [(rnd.choice("abcdefgh") if b < 6 else "a", f"v{b}.{i}", t0 + dt.timedelta(minutes=10 * b + i % 3),
                 rnd.choice([60, 900, 36_000]), 100 * b + i) for i in range(12)]
        everything += rows
        df = spark.createDataFrame(rows, "key string, value string, written_at timestamp, ttl_seconds long, write_id long")
        for _ in range(2 if b == 4 else 1):
            kv_append(spark, path, df, b)
        now = t0 + dt.timedelta(minutes=10 * b + 1)
        if b % 2:
            for _ in range(2 if b == 5 else 1):
                kv_compact(spark, path, now, b)
        full = kv_write(None, spark.createDataFrame(everything, df.schema))
        for at in (now, now + dt.timedelta(minutes=7), now + dt.timedelta(hours=5)):
            assert sorted(map(repr, kv_latest_live(kv_table(spark, path), at).drop("json").collect())) == sorted(
                map(repr, kv_latest_live(full, at).drop("json").collect()))
        counts.append((len(folders.numbered(spark, f"{path}/log", "batch_id")),
                       len(folders.numbered(spark, f"{path}/snapshot", "v"))))
    assert max(n for n, _ in counts) <= 4 and max(n for _, n in counts) <= 2
    held = _table(spark, path, 7, 7).filter(F.col("written_at") <= t0 + dt.timedelta(minutes=71))
    assert held.groupBy("key").count().filter("count > 1").count() == 0 and held.count() <= 8
