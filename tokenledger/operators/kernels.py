"""Numpy kernels for the ordered per-key scans that run inside Spark tasks
(``mapInPandas`` / ``applyInPandasWithState``). Spark partitions and sorts the
rows; these functions only turn one sorted Arrow batch into counts, without a
Python step per row.

Rows arrive sorted by (group, ts); ``new_group[i]`` is true when row i starts
a group (a key or an independent segment). Row 0 continues the carried state
when ``new_group[0]`` is false.
"""

from __future__ import annotations

import numpy as np


def _group_axis(ts: np.ndarray, new_group: np.ndarray, window: int):
    """A strictly group-separated time axis: group g's rows map to
    g * span + (ts - min), with span larger than any in-batch distance plus the
    window, so a search for ts + window never lands inside a later group.
    None when that axis would overflow int64 (then callers go group by group)."""
    gid = np.cumsum(new_group) - (1 if new_group[0] else 0)
    lo, hi = int(ts.min()), int(ts.max())
    span = hi - lo + int(window) + 1
    if int(gid[-1]) + 1 > (2 ** 62) // span:
        return None
    return gid.astype(np.int64) * span + (ts - lo)


def anchored_windows(ts: np.ndarray, new_group: np.ndarray, window: int, carry=None):
    """W1 over one sorted batch: a window opens at the first row of a group, and
    at the first row at or after ``anchor + window``; the count includes every
    row of the window so far.

    ``carry`` = (anchor_ts, count) of the row before this batch, used when row 0
    continues its group. Returns (counts, anchors, carry_out).
    """
    n = len(ts)
    counts = np.empty(n, dtype=np.int64)
    anchors = np.empty(n, dtype=np.int64)
    if n == 0:
        return counts, anchors, carry
    ts = ts.astype(np.int64, copy=False)
    start = 0
    if not new_group[0] and carry is not None:
        a, c = int(carry[0]), int(carry[1])
        end0 = int(np.argmax(new_group[1:])) + 1 if new_group[1:].any() else n
        m = int(np.searchsorted(ts[:end0], a + window, side="left"))
        counts[:m] = c + np.arange(1, m + 1)
        anchors[:m] = a
        start = m
    if start < n:
        rest_ts, rest_new = ts[start:], new_group[start:].copy()
        rest_new[0] = True                           # the first row left opens a window
        axis = _group_axis(rest_ts, rest_new, window)
        if axis is None:                             # too many groups for one axis: split
            bounds = np.flatnonzero(rest_new).tolist() + [len(rest_ts)]
            for b0, b1 in zip(bounds[:-1], bounds[1:]):
                c, a, _ = anchored_windows(rest_ts[b0:b1], rest_new[b0:b1], window)
                counts[start + b0:start + b1], anchors[start + b0:start + b1] = c, a
        else:
            nxt = np.searchsorted(axis, axis + window, side="left").tolist()
            is_anchor = np.zeros(len(rest_ts), dtype=bool)
            i, m = 0, len(rest_ts)
            while i < m:                             # one step per window, not per row
                is_anchor[i] = True
                i = nxt[i]
            pos = np.flatnonzero(is_anchor)
            win = np.cumsum(is_anchor) - 1
            counts[start:] = np.arange(m) - pos[win] + 1
            anchors[start:] = rest_ts[pos[win]]
    return counts, anchors, (int(anchors[-1]), int(counts[-1]))


def refreshed_counter(ts: np.ndarray, new_group: np.ndarray, ttl, carry=None):
    """W3 over one sorted batch: the count restarts at a group start and after a
    gap strictly longer than ``ttl`` (never when ``ttl`` is None).

    ``carry`` = (last_ts, count, session_start) of the row before this batch.
    Returns (counts, session_starts, carry_out).
    """
    n = len(ts)
    if n == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), carry
    ts = ts.astype(np.int64, copy=False)
    brk = new_group.copy()
    if ttl is not None:
        brk[1:] |= (ts[1:] - ts[:-1]) > ttl
    cont = carry is not None and not new_group[0] and (ttl is None or ts[0] - int(carry[0]) <= ttl)
    brk[0] = not cont
    pos = np.flatnonzero(brk)
    counts = np.arange(n, dtype=np.int64) + 1
    starts = np.empty(n, dtype=np.int64)
    if len(pos):
        first = int(pos[0])
        seg = np.cumsum(brk) - 1
        tail = slice(first, n)
        counts[tail] = np.arange(first, n) - pos[seg[tail]] + 1
        starts[tail] = ts[pos[seg[tail]]]
    else:
        first = n
    if cont:                                         # rows before the first break continue the carry
        counts[:first] = int(carry[1]) + np.arange(1, first + 1)
        starts[:first] = int(carry[2])
    return counts, starts, (int(ts[-1]), int(counts[-1]), int(starts[-1]))


def refreshed_counters(ts: np.ndarray, group: np.ndarray, last: np.ndarray, count: np.ndarray, ttl):
    """W3 over rows sorted by (group, ts), every group with a carry of its own: the row before had time ``last[g]``
    and count ``count[g]`` (0: there was none). A row older than that counts as of ``last[g]``.

    ``group`` holds places in ``last`` and ``count``. Returns (counts, last, count), the last two for the next batch.
    """
    last, count = last.copy(), count.copy()
    if not len(ts):
        return np.empty(0, dtype=np.int64), last, count
    known = count[group] > 0
    ts = np.where(known, np.maximum(ts, last[group]), ts)
    new = np.append(True, group[1:] != group[:-1])
    brk = new.copy()
    goes_on = new & known
    if ttl is not None:
        over = ts - np.where(new, last[group], np.append(ts[:1], ts[:-1])) > ttl
        brk |= over
        goes_on &= ~over
    pos = np.flatnonzero(brk)
    before = np.where(goes_on[pos], count[group[pos]], 0)
    seg = np.cumsum(brk) - 1
    counts = np.arange(len(ts), dtype=np.int64) - pos[seg] + 1 + before[seg]
    ends = np.flatnonzero(np.append(new[1:], True))
    last[group[ends]], count[group[ends]] = ts[ends], counts[ends]
    return counts, last, count
