"""The numpy kernels against plain sequential loops on random sorted batches,
split at random points to exercise the carried state."""

import numpy as np
import pytest

from tokenledger.operators.kernels import anchored_windows, refreshed_counter


def _batch(rng, n):
    keys = np.sort(rng.integers(0, rng.integers(1, 12), n))
    ts = np.empty(n, dtype=np.int64)
    for k in np.unique(keys):
        idx = np.flatnonzero(keys == k)
        ts[idx] = np.cumsum(rng.choice([0, 1, 5, 30, 59, 60, 61, 200], len(idx))) + rng.integers(0, 1000)
    new = np.ones(n, dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys, ts, new


def _loop_w1(ts, new, w):
    out, anchor, c = [], None, 0
    for t, g in zip(ts.tolist(), new.tolist()):
        if g or t >= anchor + w:
            anchor, c = t, 1
        else:
            c += 1
        out.append((c, anchor))
    return out


def _loop_w3(ts, new, ttl):
    out, last, c, s = [], None, 0, None
    for t, g in zip(ts.tolist(), new.tolist()):
        if g or (ttl is not None and t - last > ttl):
            c, s = 0, t
        c += 1
        last = t
        out.append((c, s))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_anchored_windows_equals_loop(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 300))
    _, ts, new = _batch(rng, n)
    want = _loop_w1(ts, new, 60)
    cuts = sorted(set(rng.integers(0, n, 3).tolist()) | {0, n})
    got, carry = [], None
    for a, b in zip(cuts[:-1], cuts[1:]):
        c, an, carry = anchored_windows(ts[a:b], new[a:b], 60, carry)
        got += list(zip(c.tolist(), an.tolist()))
    assert got == want


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("ttl", [None, 60])
def test_refreshed_counter_equals_loop(seed, ttl):
    rng = np.random.default_rng(100 + seed)
    n = int(rng.integers(1, 300))
    _, ts, new = _batch(rng, n)
    want = _loop_w3(ts, new, ttl)
    cuts = sorted(set(rng.integers(0, n, 3).tolist()) | {0, n})
    got, carry = [], None
    for a, b in zip(cuts[:-1], cuts[1:]):
        c, s, carry = refreshed_counter(ts[a:b], new[a:b], ttl, carry)
        got += list(zip(c.tolist(), s.tolist()))
    assert got == want


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("ttl", [None, 60])
def test_refreshed_counters_equal_loop(seed, ttl):
    """Batches of many groups, each group carried on from the last batch that had it."""
    from tokenledger.operators.kernels import refreshed_counters
    rng = np.random.default_rng(200 + seed)
    last, count, held = np.zeros(9, dtype=np.int64), np.zeros(9, dtype=np.int64), {}
    for _ in range(5):
        n = int(rng.integers(0, 60))
        group, ts = rng.integers(0, 9, n), rng.integers(-300, 300, n).astype(np.int64)
        order = np.lexsort((ts, group))
        group, ts = group[order], ts[order]
        want = []
        for g, t in zip(group.tolist(), ts.tolist()):
            before, c = held.get(g, (t, 0))
            t = max(t, before)
            held[g] = (t, 1 if ttl is not None and t - before > ttl else c + 1)
            want.append(held[g][1])
        counts, last, count = refreshed_counters(ts, group, last, count, ttl)
        assert counts.tolist() == want
    assert {g: (int(last[g]), int(count[g])) for g in held} == held


def test_axis_overflow_falls_back_per_group():
    ts = np.array([0, 3 * 10**18, 3 * 10**18 + 5, 6 * 10**18], dtype=np.int64)   # one axis would overflow
    new = np.array([True, True, False, True])
    c, a, _ = anchored_windows(ts, new, 60)
    assert c.tolist() == [1, 1, 2, 1]
