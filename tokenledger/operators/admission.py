"""Rate windows and admission.

W1 -- fixed window anchored at the first request: a request opens a window
when it comes ``window`` or more after the current window's anchor; the count
includes denied requests; tenants with limit <= 0 bypass the counter.

The anchor chain is a sequential recurrence, so the plan is:

1. One pass counts every key that fits a task: rows are hash-partitioned by key,
   sorted, and each Arrow batch gets the two result columns appended
   (``mapInArrow``), so nested columns, integers and nulls ride through as they
   are. Rows that take no quota are dealt evenly and skipped by the kernel.
2. Keys over ``max_segment_rows`` rows get a row id and a non-null text key and are
   staged once. ``gap_segments`` cuts their timeline wherever two consecutive
   requests are ``window`` or more apart: such a request always opens a window,
   so segments are independent and take the same pass. That scan runs over
   equi-depth buckets of (key, time, id), level by level (``sequences``).
3. Longer segments (a tenant that never pauses for ``window``) are solved
   exactly without a single task holding the segment: each row's successor
   anchor ``nxt(i)`` (first row at or after ts_i + window) is found with an
   as-of scan over such buckets, and the chain from the segment start is expanded by
   pointer doubling -- O(log chain) joins, every level checkpointed to the
   shared checkpoint folder.

Null keys are a key like any other. Requests equal in time and id count one
after another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tokenledger import constants as K
from tokenledger.operators.kernels import anchored_windows, refreshed_counter
from tokenledger.operators.sequences import SCAN_FAN, carry_last, gap_segments, ordered_buckets, with_neighbours

US = 1_000_000
MAX_SEGMENT_ROWS = 1_000_000


def _new_groups(batch: pa.RecordBatch, names: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """(row starts a group, group of the last row); nulls equal nulls, values are compared exactly."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        code = batch.column(name).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]

    def group(i: int) -> tuple:
        return tuple(batch.column(n)[i].as_py() for n in names)

    new[0] = last is None or group(0) != last
    return new, group(batch.num_rows - 1)


def _append(names: list[str], kernel, out: tuple[str, str]):
    """A ``mapInArrow`` function over partitions sorted by (names, ts, tie): the
    kernel's two columns are appended to every batch. Groups are contiguous; the
    kernel's state is carried across batches, so a group may span them."""
    def fn(batches):
        last, carry = None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new, last = _new_groups(batch, names, last)
            first, second, carry = kernel(batch.column("_ts_us").to_numpy(), new, carry)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                                             [*batch.schema.names, *out])
    return fn


def _one_pass(df: DataFrame, names: list[str], tie: str, kernel, out: tuple[str, str]) -> DataFrame:
    schema = df.schema
    for c in out:
        schema = schema.add(c, LongType())
    return (df.repartition(*names).sortWithinPartitions(*names, "_ts_us", tie)
            .mapInArrow(_append(names, kernel, out), schema))


def _windows(window_us: int):
    return lambda ts, new, carry: anchored_windows(ts, new, window_us, carry)


def _ttl(ttl_us: int | None):
    return lambda ts, new, carry: refreshed_counter(ts, new, ttl_us, carry)


def _successors(rows: DataFrame, keys: list[str], seg: str, window_us: int, max_rows: int, fan: int) -> DataFrame:
    """nxt(g): grank of the first row in the same segment with ts >= ts_g + window,
    as a bucketed carry over the union of rows and probes at ts_g + window."""
    none = F.lit(None).cast("bigint")
    probes = rows.select(*keys, seg, (F.col("_ts_us") + window_us).alias("_t"), F.lit(0).alias("_kind"),
                         F.col("_grank").alias("_src"), none.alias("_dst"))
    targets = rows.select(*keys, seg, F.col("_ts_us").alias("_t"), F.lit(1).alias("_kind"),
                          none.alias("_src"), F.col("_grank").alias("_dst"))
    both = probes.unionByName(targets).withColumn("_ord", F.struct("_kind", "_dst", "_src"))
    both, buckets = ordered_buckets(both, [*keys, seg, "_t", "_ord"], max_rows)
    found = carry_last(both, [*keys, seg], "_t", "_ord", F.col("_dst"), "_nxt", buckets, reverse=True, fan=fan)
    return found.filter(F.col("_kind") == 0).select(*keys, F.col("_src").alias("g"), F.col("_nxt").alias("j"))


def _anchors_by_doubling(rows: DataFrame, keys: list[str], seg: str, window_us: int, max_rows: int, fan: int
                         ) -> DataFrame:
    """Anchor granks of long segments, exactly, by pointer doubling."""
    span = rows.groupBy(*keys, seg).agg(((F.max("_ts_us") - F.min("_ts_us")) / window_us + 2).alias("w"))
    max_chain = span.agg(F.max("w")).first()[0]
    if max_chain is None:
        return rows.sparkSession.createDataFrame([], rows.select(*keys, F.col("_grank").alias("g")).schema)
    levels_needed = max(1, math.ceil(math.log2(max_chain)))
    level = _successors(rows, keys, seg, window_us, max_rows, fan).filter(F.col("j").isNotNull()).checkpoint()
    levels = [level]
    for _ in range(levels_needed - 1):
        a, b = level.alias("a"), level.alias("b")
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.j") == F.col("b.g")]
        level = (a.join(b, cond, "inner").select(*[F.col(f"a.{k}") for k in keys], F.col("a.g").alias("g"),
                                                 F.col("b.j").alias("j"))
                  .checkpoint())
        levels.append(level)
    # expand from the segment starts: after level k the set holds distances
    # whose binary digits below k are zero; after level 0, the whole chain
    found = rows.filter(F.col("_grank") == F.col(f"{seg}")).select(*keys, F.col("_grank").alias("g"))
    for level in reversed(levels):
        step = found.join(level, [*keys, "g"], "inner").select(*keys, F.col("j").alias("g"))
        found = found.unionByName(step).checkpoint()
    return found


def rate_limit(requests: DataFrame, window_s: int = K.RATE_WINDOW_SECONDS, keys=("tenant_id",),
               ts: str = "ts", tie: str = "request_id", limit_col: str = "limit_rpm",
               max_segment_rows: int = MAX_SEGMENT_ROWS, fan: int = SCAN_FAN,
               counted: Column | None = None) -> DataFrame:
    """Per request, ``window_count`` (count in its window after this request,
    0 when bypassed), ``window_start`` and ``allowed``.

    Ties on ``ts`` break by ``tie``. A request exactly ``window_s`` after the
    anchor opens a new window (half-open windows). A null limit reads as the
    default 60 (D6); limit <= 0 bypasses the counter. Rows for which ``counted``
    is not true never reach the counter and get nulls in all three columns.
    Every input row gives one output row, whatever its columns, key or id.
    """
    keys = list(keys)
    window_us = int(window_s * US)
    eff_limit = F.coalesce(F.col(limit_col), F.lit(K.DEFAULT_RATE_LIMIT_RPM))
    reaches = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    base = requests.withColumns({"_ts_us": F.unix_micros(F.col(ts).cast("timestamp")), "_reaches": reaches})
    takes = F.col("_reaches") & (eff_limit > 0)
    hot_keys = hot_key_table(base.filter(takes), keys, max_segment_rows)
    # rows that take no quota are dealt over 64 segments of their own
    spread = -1 - F.pmod(F.xxhash64(F.col(tie), F.col("_ts_us")), F.lit(64))
    cold, hot = split_hot(base, keys, hot_keys, takes)
    out = ("window_count", "anchor_us")
    res = _one_pass(cold.withColumn("_seg", F.when(takes, F.lit(0)).otherwise(spread).cast("bigint")),
                    [*keys, "_seg"], tie, _windows(window_us), out).drop("_seg")
    if hot is not None:
        rows, narrow = numbered(hot, keys, tie)
        counts = _segmented(narrow, ["_key"], "_tie", window_us, max_segment_rows, fan)
        res = res.unionByName(rows.join(counts.select(F.col("_tie._rid").alias("_rid"), *out), "_rid")
                              .select(*base.columns, *out))
    res = res.withColumns({
        "window_count": F.when(takes, F.col("window_count")).when(F.col("_reaches"), F.lit(0)).cast("bigint"),
        "window_start": F.when(takes, F.timestamp_micros("anchor_us"))})
    return (res.withColumn("allowed", F.when(F.col("_reaches"), (eff_limit <= 0) | (F.col("window_count") <= eff_limit)))
               .select(*requests.columns, "window_count", "window_start", "allowed"))


MAX_HOT_KEYS = 100_000


def hot_key_table(df: DataFrame, keys: list[str], max_rows: int) -> list | None:
    """Keys with more than ``max_rows`` rows; None when there are too many to ship
    (then every key takes the distributed path). A partial aggregate."""
    hot = (df.groupBy(*keys).count().filter(F.col("count") > max_rows)
           .select(*keys).limit(MAX_HOT_KEYS + 1).collect())
    return None if len(hot) > MAX_HOT_KEYS else hot


def split_hot(df: DataFrame, keys: list[str], hot: list | None, takes: Column) -> tuple[DataFrame, DataFrame | None]:
    """(cold, hot): rows that take the hot path are those of hot keys for which
    ``takes`` holds; null keys match null keys."""
    if hot == []:
        return df, None
    if hot is None:
        return df.filter(~takes), df.filter(takes)
    table = df.sparkSession.createDataFrame(hot, df.select(*keys).schema).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_is_hot"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    marked = df.join(F.broadcast(table), same, "left")                 # <= MAX_HOT_KEYS rows
    is_hot = F.coalesce(F.col("_is_hot"), F.lit(False)) & takes
    return marked.filter(~is_hot).select(*df.columns), marked.filter(is_hot).select(*df.columns)


def numbered(hot: DataFrame, keys: list[str], tie: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a unique ``_rid``, their narrow twin): staged once in the shared
    folder, so both branches see the same ids. The twin has a non-null text key
    and a tie-breaker that no two rows share."""
    rows = hot.withColumn("_rid", F.monotonically_increasing_id()).checkpoint()
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return rows, rows.select(key.alias("_key"), "_ts_us", F.struct(F.col(tie).alias("tie"), "_rid").alias("_tie"))


def _segmented(narrow: DataFrame, keys: list[str], tie: str, window_us: int, max_segment_rows: int, fan: int
               ) -> DataFrame:
    """Keys too large for one task: bucketed gap segmentation, then one pass per
    segment, and pointer doubling for segments still over the cap."""
    narrow, buckets = ordered_buckets(narrow, [*keys, "_ts_us", tie], max_segment_rows)
    seg = gap_segments(narrow, keys, "_ts_us", tie, window_us, buckets, with_len=True, fan=fan)
    # written once to the shared checkpoint folder: the long-segment check and
    # both branches below read it (no recomputation, nothing pinned in memory)
    seg = seg.select(*keys, tie, "_ts_us", "_grank", "_bucket", F.col("seg_start.grank").alias("_seg"),
                     "seg_len").checkpoint()
    short = seg.filter(F.col("seg_len") <= max_segment_rows).select(*keys, "_seg", "_ts_us", tie)
    counts = _one_pass(short, [*keys, "_seg"], tie, _windows(window_us), ("window_count", "anchor_us"))
    counts = counts.select(*keys, tie, "window_count", "anchor_us")
    if seg.filter(F.col("seg_len") > max_segment_rows).limit(1).count() > 0:
        big = seg.filter(F.col("seg_len") > max_segment_rows)
        anchors = _anchors_by_doubling(big, keys, "_seg", window_us, max_segment_rows, fan)
        marked = big.join(anchors.withColumn("_is_anchor", F.lit(True)).withColumnRenamed("g", "_grank"),
                          [*keys, "_grank"], "left")
        marked = carry_last(marked, keys, "_ts_us", tie,
                            F.when(F.col("_is_anchor"),
                                   F.struct(F.col("_grank").alias("g"), F.col("_ts_us").alias("t"))), "_anchor",
                            buckets, fan=fan)
        big_out = marked.select(*keys, tie, (F.col("_grank") - F.col("_anchor.g") + 1).alias("window_count"),
                                F.col("_anchor.t").alias("anchor_us"))
        counts = counts.unionByName(big_out)
    return counts


def remaining(limit_col: str = "limit_rpm", count_col: str = "window_count"):
    """W2 on W1 output: ``max(0, limit - count)``; limit <= 0 yields 0."""
    return F.when(F.col(limit_col) <= 0, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.col(limit_col) - F.col(count_col))).cast("bigint")


def remaining_as_of(limited: DataFrame, probes: DataFrame, window_s: int, keys=("tenant_id",),
                    ts: str = "ts", tie: str = "request_id", limit_col: str = "limit_rpm",
                    max_key_rows: int = MAX_SEGMENT_ROWS, fan: int = SCAN_FAN) -> DataFrame:
    """W2 as-of: quota left at each probe time ``t`` (``probes`` has keys, ``t``
    and the limit). The live count is that of the last W1 row at or before t if
    t is still inside its window, else 0. Requests at exactly t count first.

    An as-of join done as a carry-forward over the union of W1 rows and probes, no
    pair enumeration: one window per key, and for keys over ``max_key_rows`` rows the
    scan over equi-depth buckets. Null keys are one key; ids may be of any ordered
    type; rows equal in time and id count in the order of their counts.
    """
    keys = list(keys)
    window_us = int(window_s * US)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key")
    tie_type = limited.schema[tie].dataType
    state = F.struct(F.unix_micros("window_start").alias("a"), F.col("window_count").alias("n"))
    rows = limited.select(key, *keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_ts_us"), state.alias("_state"),
                          F.struct(F.lit(0).alias("kind"), F.col(tie).alias("tie"), state.alias("state"),
                                   F.lit(0).cast("bigint").alias("id")).alias("_ord"),
                          F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("int").alias(limit_col))
    none = F.lit(None).cast("struct<a:bigint,n:bigint>")
    pr = probes.select(key, *keys, F.unix_micros(F.col("t").cast("timestamp")).alias("_ts_us"), none.alias("_state"),
                       F.struct(F.lit(1).alias("kind"), F.lit(None).cast(tie_type).alias("tie"), none.alias("state"),
                                F.monotonically_increasing_id().alias("id")).alias("_ord"),
                       F.col("t").cast("timestamp").alias("t"), F.col(limit_col).cast("int").alias(limit_col))
    both = rows.unionByName(pr)
    cold, hot = split_hot(both, ["_key"], hot_key_table(both, ["_key"], max_key_rows), F.lit(True))
    w = Window.partitionBy("_key").orderBy("_ts_us", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    both = cold.withColumn("_live", F.last("_state", ignorenulls=True).over(w))
    if hot is not None:
        hot, buckets = ordered_buckets(hot, ["_key", "_ts_us", "_ord"], max_key_rows)
        both = both.unionByName(carry_last(hot, ["_key"], "_ts_us", "_ord", F.col("_state"), "_live", buckets, fan=fan)
                                .drop("_bucket"))
    out = both.filter(F.col("_ord.kind") == 1)
    live = F.when(F.col("_live").isNotNull() & (F.col("_ts_us") < F.col("_live.a") + window_us),
                  F.col("_live.n")).otherwise(F.lit(0))
    return out.select(*keys, "t", limit_col, live.cast("bigint").alias("live_count"),
                      F.when(F.col(limit_col) <= 0, F.lit(0))
                       .otherwise(F.greatest(F.lit(0), F.col(limit_col) - live)).cast("bigint").alias("remaining"))


def ttl_counter(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id",
                ttl_s: int | None = None, max_key_rows: int = MAX_SEGMENT_ROWS, fan: int = SCAN_FAN) -> DataFrame:
    """Counter whose expiry is refreshed on every increment.

    With a ttl the count restarts after a gap strictly longer than ttl (a gap
    equal to ttl keeps counting); without a ttl it never restarts. Adds
    ``counter`` and ``session_start``. Keys with at most ``max_key_rows`` rows
    take one sorted pass per partition; hotter keys take the bucketed scan.
    Null keys are one key; events equal in time and id count one after another.
    """
    base = events.withColumn("_ts_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ttl_us = None if ttl_s is None else int(ttl_s * US)
    cold, hot = split_hot(base, [key], hot_key_table(base, [key], max_key_rows), F.lit(True))
    res = _one_pass(cold, [key], tie, _ttl(ttl_us), ("counter", "_start_us"))
    if hot is not None:
        rows, narrow = numbered(hot, [key], tie)
        narrow, buckets = ordered_buckets(narrow, ["_key", "_ts_us", "_tie"], max_key_rows)
        if ttl_us is None:
            d = with_neighbours(narrow, ["_key"], "_ts_us", "_tie", buckets, fan)
            d = d.select("_tie._rid", F.col("_grank").alias("counter"), F.lit(None).cast("bigint").alias("_start_us"))
        else:
            d = gap_segments(narrow, ["_key"], "_ts_us", "_tie", ttl_us, buckets, inclusive=False, fan=fan)
            d = d.select("_tie._rid", F.col("seg_rank").alias("counter"), F.col("seg_start.ts").alias("_start_us"))
        d = d.select("_rid", F.col("counter").cast("bigint").alias("counter"), "_start_us")
        res = res.unionByName(rows.join(d, "_rid").select(*base.columns, "counter", "_start_us"))
    start = F.timestamp_micros("_start_us") if ttl_us is not None else F.lit(None).cast("timestamp")
    return res.select(*events.columns, "counter", start.alias("session_start"))


def admit(requests: DataFrame, window_s: int = K.RATE_WINDOW_SECONDS, scan_col: str = "scan_hit",
          **kw) -> DataFrame:
    """Ordered admission decision per request.

    stream -> 501 before the counter (uses no quota); over the limit -> 429;
    injection hit -> 400 (quota already used); else 200. ``requests`` must carry
    ``stream`` (null: false), ``limit_rpm`` and a precomputed ``scan_hit`` column.
    All rows go through one pass; streamed ones are skipped by the counter.
    """
    counted = ~F.coalesce(F.col("stream"), F.lit(False))
    return admission_decision(rate_limit(requests, window_s=window_s, counted=counted, **kw), scan_col)


def admission_decision(df: DataFrame, scan_col: str = "scan_hit") -> DataFrame:
    """P16's ordered rule on rows carrying ``stream``, ``allowed`` (W1) and the
    scan hit: stream -> 501, over the limit -> 429, injection -> 400, else 200."""
    status = (F.when(F.col("stream"), F.lit(501))                     # a null ``stream`` is false
               .when(~F.col("allowed"), F.lit(429))
               .when(F.col(scan_col).isNotNull(), F.lit(400))
               .otherwise(F.lit(200)))
    reason = (F.when(F.col("stream"), F.lit("streaming not supported"))
               .when(~F.col("allowed"), F.lit("rate limit exceeded"))
               .when(F.col(scan_col).isNotNull(), F.concat(F.lit("injection: "), F.col(scan_col))))
    return df.withColumn("status", status).withColumn("reason", reason)
