"""Ordered scans per key that stay parallel when one key is hot.

A window ``partitionBy(key).orderBy(ts)`` puts every row of a key in one task;
a tenant holding a third of the traffic would then run in a single task. Here
rows are cut into equi-depth buckets of the order ``(key, ts, tie)``: Spark's
range partitioner sketches the quantiles of that order, so the cuts follow the
rows of each key -- a burst of a microsecond gets as many buckets as it needs, a
quiet year none -- and the number of buckets follows the row count alone. Every
scan then has levels:

1. a window over ``(key, bucket)`` computes the in-bucket part (lag, lead, rank,
   last-non-null so far);
2. a per-(key, bucket) summary, one row per bucket of a key, is scanned for what
   each bucket inherits from its neighbours (previous/next timestamp, rows
   before, last marked row), and joined back on ``(key, bucket)``;
3. where there are more than ``SCAN_FAN`` buckets, the summary is scanned in runs
   of ``SCAN_FAN`` buckets and summed up once more, level by level, so no window of
   any level exceeds its bound.

The row-level windows and joins all use the ``(key, bucket)`` hash
partitioning, so a whole scan costs one shuffle of the rows after the sort; the
summaries are small. ``ts`` is in microseconds (BIGINT); ``tie`` makes the order
of a key's rows unique, so equal times can be cut apart too.

Two more order-based helpers follow the same rule (no task holds a whole key):
``last_k_per_key`` (the k largest values of an append sequence per key, from a
per-range count) and ``global_positions`` (1-based positions in one total
order, from a range-partitioned sort and per-partition offsets).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: buckets of one key that a single window scans
SCAN_FAN = 10_000


def floor_div(c: Column, width: int) -> Column:
    """Exact integer floor(c / width) for BIGINT ``c`` (no double rounding at
    bucket edges, right for negative values too)."""
    return ((c - F.pmod(c, F.lit(width))) / F.lit(width)).cast("bigint")


def ordered_buckets(df: DataFrame, order: list[str], max_rows: int) -> tuple[DataFrame, int]:
    """(``df`` with ``_bucket`` rising along ``order``, number of buckets): no bucket
    holds more than ``max_rows`` rows where ``order`` tells rows apart.

    A range-partitioned sort, written to the shared checkpoint folder, whose
    partitions are the buckets. They are planned half full; should the sketch of
    the quantiles be off by more, the sort is repeated with twice as many. One
    number a round reaches the driver.
    """
    n = df.count()
    parts = max(1, math.ceil(2 * n / max_rows))
    for last in (False, False, False, True):
        out = (df.repartitionByRange(parts, *order)
               .withColumn("_bucket", F.spark_partition_id().cast("bigint")).checkpoint())
        if last or parts == 1 or parts >= n:
            break
        densest = out.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if densest <= max_rows:
            break
        parts = min(n, 2 * parts)
    return out, parts


def scan_buckets(stats: DataFrame, keys: list[str], buckets: int, sums: tuple[str, ...] = (),
                 prior: tuple[str, ...] = (), later: tuple[str, ...] = (), fan: int = SCAN_FAN) -> DataFrame:
    """Replace summary columns (one row per key and ``_bucket`` < ``buckets``) by what a bucket inherits.

    ``sums``: the sum over the key's earlier buckets (0 for the first); ``prior`` /
    ``later``: the last / first non-null value of earlier / later buckets. A window
    scans at most ``fan`` rows; more buckets are scanned in runs of ``fan``, and the
    runs' summaries by the same rule.
    """
    wide = buckets > fan
    s = stats.withColumn("_run", floor_div(F.col("_bucket"), fan)) if wide else stats
    group = [*keys, "_run"] if wide else keys
    up = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*group).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    scanned = s.select(*group, "_bucket",
                       *[F.coalesce(F.sum(c).over(up), F.lit(0)).cast("bigint").alias(c) for c in sums],
                       *[F.last(c, ignorenulls=True).over(up).alias(c) for c in prior],
                       *[F.last(c, ignorenulls=True).over(down).alias(c) for c in later])
    if not wide:
        return scanned

    def filled(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col("_bucket"))

    runs = s.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums], *[F.max_by(c, filled(c)).alias(c) for c in prior],
                                 *[F.min_by(c, filled(c)).alias(c) for c in later]).withColumnRenamed("_run", "_bucket")
    above = scan_buckets(runs, keys, math.ceil(buckets / fan), sums, prior, later, fan)
    above = above.select(*keys, F.col("_bucket").alias("_run"),
                         *[F.col(c).alias(f"_above{c}") for c in (*sums, *prior, *later)])
    both = scanned.join(above, group)
    return both.select(*keys, "_bucket", *[(F.col(c) + F.col(f"_above{c}")).alias(c) for c in sums],
                       *[F.coalesce(F.col(c), F.col(f"_above{c}")).alias(c) for c in (*prior, *later)])


def with_neighbours(df: DataFrame, keys: list[str], ts_us: str, tie: str, buckets: int, fan: int = SCAN_FAN) -> DataFrame:
    """Add ``_prev_ts`` / ``_next_ts`` (neighbour timestamps within the key, null
    at the ends) and ``_grank`` (1-based rank within the key). Needs ``_bucket``."""
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts_us, tie)
    rows = (df.withColumn("_rn", F.row_number().over(w))
              .withColumn("_lag", F.lag(ts_us).over(w))
              .withColumn("_lead", F.lead(ts_us).over(w)))
    # summaries come from the input, not the windowed rows: same values, and the
    # summary branch does not repeat the window
    stats = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows_before"), F.max(ts_us).alias("_prev_max"),
                                              F.min(ts_us).alias("_next_min"))
    stats = scan_buckets(stats, keys, buckets, ("_rows_before",), ("_prev_max",), ("_next_min",), fan)
    out = rows.join(stats, [*keys, "_bucket"], "inner")
    return (out.withColumn("_prev_ts", F.coalesce(F.col("_lag"), F.col("_prev_max")))
               .withColumn("_next_ts", F.coalesce(F.col("_lead"), F.col("_next_min")))
               .withColumn("_grank", F.col("_rows_before") + F.col("_rn"))
               .drop("_lag", "_lead", "_prev_max", "_next_min", "_rn", "_rows_before"))


def carry_last(df: DataFrame, keys: list[str], ts_us: str, tie: str, value: Column, out: str, buckets: int,
               reverse: bool = False, fan: int = SCAN_FAN) -> DataFrame:
    """Add ``out`` = the last non-null ``value`` at or before each row (with
    ``reverse``: the first at or after) in ``(ts, tie)`` order within the key.
    Needs ``_bucket``."""
    order = [F.col(ts_us).desc(), F.col(tie).desc()] if reverse else [F.col(ts_us), F.col(tie)]
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_v", value)
    rows = marked.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    pos = F.struct(F.col(ts_us), F.col(tie))
    pick = F.min_by if reverse else F.max_by
    stats = marked.groupBy(*keys, "_bucket").agg(pick(F.col("_v"), F.when(F.col("_v").isNotNull(), pos))
                                                 .alias("_carry"))
    stats = scan_buckets(stats, keys, buckets, **{"later" if reverse else "prior": ("_carry",)}, fan=fan)
    res = rows.join(stats, [*keys, "_bucket"], "inner")
    return res.withColumn(out, F.coalesce(F.col("_in"), F.col("_carry"))).drop("_v", "_in", "_carry")


def gap_segments(df: DataFrame, keys: list[str], ts_us: str, tie: str, gap_us: int, buckets: int,
                 inclusive: bool = True, with_len: bool = False, fan: int = SCAN_FAN) -> DataFrame:
    """Split each key's timeline where consecutive rows are ``gap_us`` or more
    apart (``inclusive``), or strictly more than ``gap_us`` apart. Needs ``_bucket``.

    Adds ``_grank``, ``seg_start`` = struct(ts, tie, grank) of the segment's first
    row, ``seg_rank`` (1-based position in the segment) and, with ``with_len``,
    ``seg_len`` (rows in the segment).
    """
    d = with_neighbours(df, keys, ts_us, tie, buckets, fan)

    def is_gap(a: Column, b: Column) -> Column:
        return (b - a >= gap_us) if inclusive else (b - a > gap_us)

    d = d.withColumn("_brk", F.col("_prev_ts").isNull() | is_gap(F.col("_prev_ts"), F.col(ts_us)))
    d = carry_last(d, keys, ts_us, tie,
                   F.when(F.col("_brk"), F.struct(F.col(ts_us).alias("ts"), F.col(tie).alias("tie"),
                                                  F.col("_grank").alias("grank"))), "seg_start", buckets, fan=fan)
    d = d.withColumn("seg_rank", F.col("_grank") - F.col("seg_start.grank") + 1)
    if with_len:
        is_end = F.col("_next_ts").isNull() | is_gap(F.col(ts_us), F.col("_next_ts"))
        d = carry_last(d, keys, ts_us, tie, F.when(is_end, F.col("_grank")), "_seg_end", buckets, reverse=True, fan=fan)
        d = d.withColumn("seg_len", F.col("_seg_end") - F.col("seg_start.grank") + 1).drop("_seg_end")
    return d.drop("_brk")


def last_k_per_key(df: DataFrame, keys: list[str], order_col: str, k: int,
                   width: int = 1_000_000) -> DataFrame:
    """Rows with the ``k`` largest ``order_col`` values per key (``order_col``
    unique within a key, e.g. an append sequence).

    Never a per-key window over all rows and never a single merge task:
    ``order_col`` is cut into ranges of ``width`` values; a per-(key, range)
    count (partial aggregate, one row per range) gives the rows after each
    range, so whole ranges are kept or dropped from the summary, and only rows
    of kept ranges are ranked, per (key, range): at most ``width`` rows a task.
    """
    from tokenledger.operators.dimensions import lookup_join
    d = df.withColumn("_r", floor_div(F.col(order_col).cast("bigint"), width))
    s = d.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("_r").desc())
    s = s.withColumn("_after", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)))
    s = s.filter(F.col("_after") < k).select(*keys, "_r", "_after")
    # the kept summary has at most k rows per key (each kept range holds a row)
    j = lookup_join(d, s, [*keys, "_r"], "inner")
    rw = Window.partitionBy(*keys, "_r").orderBy(F.col(order_col).desc())
    return (j.withColumn("_rk", F.row_number().over(rw))
             .filter(F.col("_rk") <= F.lit(k) - F.col("_after"))
             .drop("_r", "_after", "_rk"))


def global_positions(df: DataFrame, order_cols: list, out: str = "_pos") -> DataFrame:
    """1-based position of every row in one total order (``order_cols`` unique).

    A range-partitioned sort (parallel), then per-partition offsets, the way
    ``zipWithIndex`` numbers rows: the sorted rows are checkpointed to the
    shared checkpoint folder so the partition sizes and the numbering come from
    one evaluation; the offsets table has one row per sort partition (a bounded
    broadcast).
    """
    tagged = (df.orderBy(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint())
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))      # row number inside the partition
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, F.col("_off") + local + 1)
                  .drop("_pid", "_mid", "_off"))
