"""W1/W2/W3 against a plain sequential model on seeded random inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tokenledger.operators.admission import admit, rate_limit, remaining, remaining_as_of, ttl_counter
from tokenledger.operators.sequences import ordered_buckets, scan_buckets

T0 = dt.datetime(2024, 1, 1)


def _loop_anchored(rows, window_s):
    """rows: (tenant, ts, id, limit) -> {id: (count, allowed)} by the plain rule."""
    out, state = {}, {}
    for tenant, ts, rid, limit in sorted(rows, key=lambda r: (r[1], r[2])):
        if limit is not None and limit <= 0:
            out[rid] = (0, True)
            continue
        lim = 60 if limit is None else limit
        anchor, n = state.get(tenant, (None, 0))
        if anchor is None or (ts - anchor).total_seconds() >= window_s:
            anchor, n = ts, 0
        n += 1
        state[tenant] = (anchor, n)
        out[rid] = (n, n <= lim)
    return out


def _random_requests(seed, n=400, tenants=4):
    rnd = random.Random(seed)
    limits = {f"t{i}": rnd.choice([1, 2, 3, 0, -1, None]) for i in range(tenants)}
    rows, t = [], T0
    for i in range(n):
        t = t + dt.timedelta(seconds=rnd.choice([0, 1, 5, 30, 59, 60, 61, 120, 600]))
        tenant = f"t{rnd.randrange(tenants)}"
        rows.append((tenant, t, i, limits[tenant]))
    return rows


@pytest.mark.parametrize("seed,max_rows,fan", [(1, 1_000_000, 10_000), (2, 1_000_000, 3), (3, 5, 10_000), (3, 5, 3)])
def test_rate_limit_matches_loop(spark, seed, max_rows, fan):
    rows = _random_requests(seed)
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int")
    got = {r["request_id"]: (r["window_count"], r["allowed"])
           for r in rate_limit(df, window_s=60, max_segment_rows=max_rows, fan=fan).collect()}
    assert got == _loop_anchored(rows, 60)


def test_rate_limit_boundaries(spark):
    rows = [("a", T0, 1, 2), ("a", T0 + dt.timedelta(seconds=59, microseconds=999999), 2, 2),
            ("a", T0 + dt.timedelta(seconds=59, microseconds=999999), 3, 2),   # denied, still counted
            ("a", T0 + dt.timedelta(seconds=60), 4, 2),                        # exactly W after anchor
            ("z", T0, 5, 0), ("n", T0, 6, -3)]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int")
    got = {r["request_id"]: (r["window_count"], r["allowed"]) for r in rate_limit(df, window_s=60).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, False), 4: (1, True), 5: (0, True), 6: (0, True)}


def test_remaining(spark):
    rows = [("a", T0, 1, 2)]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int")
    rl = rate_limit(df, window_s=60)
    assert rl.select(remaining()).first()[0] == 1
    probes = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=30), 2), ("a", T0 + dt.timedelta(seconds=60), 2),
                                    ("b", T0, 0)], "tenant_id string, t timestamp, limit_rpm int")
    got = sorted((r["t"], r["remaining"]) for r in remaining_as_of(rl, probes, 60).collect())
    assert [x[1] for x in got] == [0, 1, 2]    # limit 0 -> 0; inside window -> 1; past window -> full


def test_remaining_as_of_with_null_keys_and_text_ids(spark):
    rows = [(None, T0 + dt.timedelta(seconds=i), f"r{i}", 5) for i in range(3)] + [("a", T0, "x", 2), ("a", T0, "y", 2)]
    rl = rate_limit(spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id string, limit_rpm int"), window_s=60)
    probes = spark.createDataFrame([(None, T0 + dt.timedelta(seconds=1), 5), (None, T0 + dt.timedelta(seconds=61), 5), ("a", T0, 2)],
                                   "tenant_id string, t timestamp, limit_rpm int")
    for cap in (10**6, 1):
        got = remaining_as_of(rl, probes, 60, max_key_rows=cap, fan=2).collect()
        assert sorted(r["remaining"] for r in got) == [0, 3, 5]


def _loop_ttl(rows, ttl):
    out, state = {}, {}
    for key, ts, rid in sorted(rows, key=lambda r: (r[1], r[2])):
        last, n = state.get(key, (None, 0))
        if ttl is not None and last is not None and (ts - last).total_seconds() > ttl:
            n = 0
        n += 1
        state[key] = (ts, n)
        out[rid] = n
    return out


@pytest.mark.parametrize("ttl,cap", [(None, 10**6), (60, 10**6), (600, 10**6), (None, 20), (60, 20), (600, 20)])
def test_ttl_counter_matches_loop(spark, ttl, cap):
    rows = [(t, ts, i) for t, ts, i, _ in _random_requests(7, n=300)]
    rows.append(("g", T0, 10_000))
    rows.append(("g", T0 + dt.timedelta(seconds=60), 10_001))     # gap == ttl keeps counting
    rows.append(("g", T0 + dt.timedelta(seconds=120, microseconds=1), 10_002))
    df = spark.createDataFrame(rows, "k string, ts timestamp, event_id long")
    got = {r["event_id"]: r["counter"] for r in ttl_counter(df, "k", ttl_s=ttl, max_key_rows=cap, fan=4).collect()}
    assert got == _loop_ttl(rows, ttl)


def test_long_segment_by_pointer_doubling(spark):
    """A tenant that never pauses for the window: one 400-row segment, solved by
    the exact doubling path (cap 50 rows) and compared with the plain rule."""
    rnd = random.Random(11)
    rows, t = [], T0
    for i in range(400):
        t = t + dt.timedelta(seconds=rnd.choice([1, 3, 7, 13, 29]))
        rows.append(("hot", t, i, 3))
    rows += [("cold", T0 + dt.timedelta(minutes=5 * i), 1000 + i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int")
    got = {r["request_id"]: (r["window_count"], r["allowed"])
           for r in rate_limit(df, window_s=60, max_segment_rows=50, fan=4).collect()}
    assert got == _loop_anchored(rows, 60)


def test_hot_paths_equal_default_on_driver_tables(spark):
    """The bucketed / pointer-doubling paths, forced with small caps, give the
    default path's answer on the sf0.01 tables (one 1,000-row segment per tenant)."""
    from tokenledger.plans import catalog as C
    from tokenledger.sources.tables import read_table
    sf = "/root/testdata/sf0.01"
    req = C._rl_requests(spark, sf)
    cols = ["request_id", "window_count", "allowed"]
    base = sorted(tuple(r) for r in rate_limit(req, window_s=3600).select(*cols).collect())
    hot = sorted(tuple(r) for r in rate_limit(req, window_s=3600, max_segment_rows=200)
                 .select(*cols).collect())
    assert base == hot
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    a = sorted(tuple(r) for r in ttl_counter(ev, "user_id", ttl_s=7200).select("event_id", "counter").collect())
    b = sorted(tuple(r) for r in ttl_counter(ev, "user_id", ttl_s=7200, max_key_rows=20)
               .select("event_id", "counter").collect())
    assert a == b


def test_rate_limit_wide_rows_take_the_narrow_pass(spark):
    rows = _random_requests(5)
    df = spark.createDataFrame([r + ([r[2], r[2] + 1],) for r in rows],
                               "tenant_id string, ts timestamp, request_id long, limit_rpm int, payload array<long>")
    out = rate_limit(df, window_s=60).collect()
    assert {r["request_id"]: (r["window_count"], r["allowed"]) for r in out} == _loop_anchored(rows, 60)
    assert all(r["payload"] == [r["request_id"], r["request_id"] + 1] for r in out)   # wide column intact


def test_ttl_counter_wide_rows(spark):
    rows = [("u", T0 + dt.timedelta(seconds=s), i, [i]) for i, s in enumerate([0, 10, 100, 105, 400])]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp, event_id long, payload array<long>")
    out = {r["event_id"]: (r["counter"], r["payload"]) for r in ttl_counter(df, "user_id", ttl_s=60).collect()}
    assert out == {0: (1, [0]), 1: (2, [1]), 2: (1, [2]), 3: (2, [3]), 4: (1, [4])}


PAYLOADS = {"narrow": ("", lambda i: ()), "wide": (", payload array<long>", lambda i: ([i, i + 1],))}


@pytest.mark.parametrize("kind", list(PAYLOADS))
@pytest.mark.parametrize("cap", [10**6, 2])
def test_every_request_row_comes_back(spark, kind, cap):
    """Null keys, repeated ids, null limits and null ``stream``: rows in = rows out, on cold and hot paths."""
    extra, payload = PAYLOADS[kind]
    at = [(None, 0, 1), (None, 1, 1), (None, 70, 2), ("a", 0, 5), ("a", 0, 5), ("a", 0, 6), ("a", 61, 7), ("z", 3, 8)]
    rows = [(k, T0 + dt.timedelta(seconds=s), i, None, None if i % 2 else False, None, *payload(i)) for k, s, i in at]
    rows += [("a", T0, 9, 3, True, None, *payload(9)), ("z", T0, 10, 0, False, "x", *payload(10))]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int, stream boolean, "
                                     "scan_hit string" + extra)
    out = admit(df, window_s=60, max_segment_rows=cap, fan=2)
    got = sorted(((r["tenant_id"] or "", r["request_id"], r["window_count"], r["status"]) for r in out.collect()), key=repr)
    assert got == sorted([("", 1, 1, 200), ("", 1, 2, 200), ("", 2, 1, 200), ("a", 5, 1, 200), ("a", 5, 2, 200),
                          ("a", 6, 3, 200), ("a", 7, 1, 200), ("z", 8, 1, 200), ("a", 9, None, 501),
                          ("z", 10, 0, 400)], key=repr)
    assert out.columns == [*df.columns, "window_count", "window_start", "allowed", "status", "reason"]
    if extra:
        assert all(r["payload"] == [r["request_id"], r["request_id"] + 1] for r in out.collect())


@pytest.mark.parametrize("kind", list(PAYLOADS))
@pytest.mark.parametrize("cap,ttl", [(10**6, 60), (2, 60), (10**6, None), (2, None)])
def test_ttl_counter_with_null_and_large_integer_keys(spark, kind, cap, ttl):
    extra, payload = PAYLOADS[kind]
    big = 2**53
    at = [(None, 0, 1), (None, 1, 2), (None, 2, 2), (big, 0, 3), (big + 1, 1, 4), (big, 2, 5), (big + 1, 200, 6)]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), i, *payload(i)) for k, s, i in at],
                               "user_id long, ts timestamp, event_id long" + extra)
    got = sorted(((r["user_id"] or 0, r["event_id"], r["counter"]) for r in
                  ttl_counter(df, "user_id", ttl_s=ttl, max_key_rows=cap, fan=2).collect()))
    assert got == sorted([(0, 1, 1), (0, 2, 2), (0, 2, 3), (big, 3, 1), (big, 5, 2), (big + 1, 4, 1),
                          (big + 1, 6, 1 if ttl else 2)])


def _bursts():
    """A key of regular rows with a burst in one microsecond, and a quiet key."""
    rows = [("hot", i * 3_600_000_000, i) for i in range(1000)] + [("hot", 7_200_000_000, 10_000 + i) for i in range(3000)]
    return rows + [("quiet", i * 10**12, 20_000 + i) for i in range(5)]


def test_buckets_are_equi_depth_whatever_the_times(spark):
    df = spark.createDataFrame(_bursts(), "k string, t long, id long")
    out, buckets = ordered_buckets(df, ["k", "t", "id"], 100)
    per = out.groupBy("_bucket").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "id")).alias("a"),
                                     F.max(F.struct("k", "t", "id")).alias("z")).orderBy("_bucket").collect()
    assert max(r["n"] for r in per) <= 100 and len(per) <= buckets <= 4 * 4005 // 100
    assert all(x["z"] < y["a"] for x, y in zip(per, per[1:])) and sum(r["n"] for r in per) == 4005
    assert ordered_buckets(df.limit(0), ["k", "t", "id"], 100)[0].count() == 0


@pytest.mark.parametrize("fan", [2, 3, 7, 100])
def test_bucket_scan_over_several_levels(spark, fan):
    rnd = random.Random(fan)
    rows = [(k, b, rnd.randrange(9), rnd.choice([None, rnd.randrange(99)])) for k in "xy" for b in range(50) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, _bucket long, n long, v long").withColumn("w", F.col("v"))
    got = {(r["k"], r["_bucket"]): (r["n"], r["v"], r["w"]) for r in
           scan_buckets(df, ["k"], 50, ("n",), ("v",), ("w",), fan).collect()}
    want = {}
    for k, b, *_ in rows:
        before = sorted((c, n, v) for j, c, n, v in rows if j == k and c < b)
        after = sorted((c, v) for j, c, _, v in rows if j == k and c > b and v is not None)
        seen = [v for *_, v in before if v is not None]
        want[k, b] = (sum(n for _, n, _ in before), seen[-1] if seen else None, after[0][1] if after else None)
    assert got == want


def test_no_window_of_a_hot_key_exceeds_its_bound(spark, monkeypatch):
    """A burst in one instant and a long steady stream of one key: bucket and summary sizes stay bounded at every level."""
    from tokenledger.operators import sequences as Q
    cap, fan, levels = 100, 4, []
    plain = Q.scan_buckets

    def watched(stats, keys, buckets, *a, **kw):
        group = [*keys, Q.floor_div(F.col("_bucket"), fan)] if buckets > fan else keys
        levels.append(stats.groupBy(*group).count().agg(F.max("count")).first()[0])
        return plain(stats, keys, buckets, *a, **kw)

    monkeypatch.setattr(Q, "scan_buckets", watched)
    rows = [(k, T0 + dt.timedelta(microseconds=t), i, 3) for k, t, i in _bursts()]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int")
    got = {r["request_id"]: (r["window_count"], r["allowed"])
           for r in rate_limit(df, window_s=7200, max_segment_rows=cap, fan=fan).collect()}
    assert got == _loop_anchored(rows, 7200)
    assert levels and max(levels) <= fan


def test_remaining_as_of_of_a_hot_key(spark):
    rows = [("a", T0 + dt.timedelta(seconds=s), i // 2, 50) for i, s in enumerate(sorted(random.Random(3).choices(range(900), k=300)))]
    rl = rate_limit(spark.createDataFrame(rows, "tenant_id string, ts timestamp, request_id long, limit_rpm int"), window_s=60)
    probes = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), 50) for s in range(0, 1000, 7)] + [("a", T0, 50)] * 40,
                                   "tenant_id string, t timestamp, limit_rpm int")
    cold = sorted((r["t"], r["live_count"]) for r in remaining_as_of(rl, probes, 60).collect())
    hot = sorted((r["t"], r["live_count"]) for r in remaining_as_of(rl, probes, 60, max_key_rows=20, fan=3).collect())
    counts = [(r["ts"], r["window_start"], r["window_count"]) for r in rl.collect()]
    for t, n in cold:
        past = [(s, a, c) for s, a, c in counts if s <= t]
        s, a, c = max(past, key=lambda x: (x[1], x[2]), default=(None, None, 0))
        assert n == (c if a is not None and t < a + dt.timedelta(seconds=60) else 0)
    assert cold == hot
