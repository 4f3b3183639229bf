"""Structured Streaming jobs (ST1-ST5).

ST1  requests -> tenant config (stream-static, ST4) -> anchored rate window
     per tenant as keyed state (applyInPandasWithState) -> counts / allowed;
     with the scan, prompt isolation and tool scoping -> admission status
ST2  audit stream -> Parquet file sink partitioned by event date (S4)
ST3  audit stream -> usage rollup deltas -> idempotent upsert (foreachBatch, S5);
     or a stateful aggregate with a watermark in update mode
ST5  TTL counter per key as keyed state; or sessions of a watermarked
     ``session_window``

The rate window and the counter decide on arrival, as the service does: a key's
rows are taken chunk by chunk as Spark hands them over (an Arrow batch at a time,
sorted by (ts, id) inside the chunk), and the state of a key is one record carried
from chunk to chunk and batch to batch. Nothing holds a key's whole micro-batch.
The counter, whose keys are many and have few rows each, takes the keys of a hash
bucket together: larger chunks of the bucket, and one record with a place per key.
The result equals the batch twin when rows arrive in time order. The watermark in
front of this state is on the arrival clock and lets silent keys leave; no row is
dropped by its event time: a row older than its key's newest
by more than ``lateness`` is not counted and comes out marked ``late``; a younger
one that comes out of order counts in the window that is open. Every row in gives
one row out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, IntegralType, LongType, StringType, StructField, StructType

from tokenledger import constants as K
from tokenledger.operators.kernels import anchored_windows, refreshed_counters
from tokenledger.operators.rollup import COUNTERS as ROLLUP_COUNTERS
from tokenledger.session import scratch_path

US = 1_000_000
_COUNTED = [StructField("window_count", LongType()), StructField("anchor_us", LongType()), StructField("late", BooleanType())]


#: rows of one staged chunk, about: the most that one write task and one micro-batch get
CHUNK_ROWS = 1_000_000


def stage_time_ordered(df: DataFrame, ts: str, path: str, n_files: int = 4, chunk_rows: int = CHUNK_ROWS,
                       tie: str | None = None) -> str:
    """Write ``df`` as time-ordered chunks, one file each and one job per chunk, so
    file modification times follow event time: ``n_files`` chunks, or more where
    these would hold over about ``chunk_rows`` rows. Chunks are ranges of the time,
    and no instant is cut apart; a chunk's rows stand in (ts, tie) order. All rows
    are cut in one job, and a chunk's job reads that chunk alone. This stages
    derived test input to replay as arrivals; it is not part of the stream
    operators. Returns a glob for readStream."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    df = df.persist()                     # one evaluation for the ranges and the write
    n_rows, n_timed = df.agg(F.count(F.lit(1)), F.count(t)).first()
    n = max(n_files, -(-n_rows // chunk_rows))
    rows = df.filter(t.isNotNull()) if n_timed else df
    cut = rows.repartitionByRange(n, t).withColumn("_chunk", F.spark_partition_id())
    cut.write.partitionBy("_chunk").mode("overwrite").parquet(f"{path}/cut")
    df.unpersist()
    if not n_rows:
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/chunk_0000")
        return f"{path}/chunk_*/*.parquet"
    cut = df.sparkSession.read.schema(cut.schema).parquet(f"{path}/cut")
    order = [t, tie] if tie else [t]
    for i in sorted(r["_chunk"] for r in cut.select("_chunk").distinct().collect()):
        # the file source takes one file per trigger in modification-time order,
        # so a chunk split over several files could arrive out of time order
        chunk = cut.filter(F.col("_chunk") == i).drop("_chunk")
        chunk.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/chunk_{i:04d}")
    return f"{path}/chunk_*/*.parquet"


def file_stream(spark: SparkSession, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(glob)


def run_available(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ------------------------------------------------------------------ keyed state
#: how much older than its key's newest row a row may be and still count
LATENESS = "1 day"
#: a key that is silent for so long (on the cluster's clock) leaves the state; longer than any window
KEEP = "2 days"
#: how far the clocks of successive drivers may lie apart
CLOCK_SKEW = "1 hour"
#: status and reason of late rows
LATE_STATUS, LATE_REASON = 408, "late: older than the stream's lateness"
#: buckets of the TTL counter's keys, and rows of a bucket, about, that are put in order at once
COUNTER_BUCKETS, COUNTER_ROWS = 1024, 100_000


def interval_us(text: str) -> int:
    """Microseconds of an interval such as '10 minutes'."""
    return int(pd.Timedelta(text).total_seconds() * US)


def _chunks(batches, tie: str, seen: int | None, lateness_us: int):
    """(rows in (ts, tie) order, which are late, newest time so far) of each chunk of a key's rows."""
    for pdf in batches:
        pdf = pdf.sort_values(["_ts_us", tie], kind="stable")
        ts = pdf["_ts_us"].to_numpy(dtype=np.int64)
        newest = np.maximum.accumulate(ts if seen is None else np.maximum(ts, seen))
        if len(ts):
            seen = int(newest[-1])
        yield pdf, ts < newest - lateness_us, seen


def _on_arrival(df: DataFrame, clock_skew: str) -> DataFrame:
    """The stream with the time of its micro-batch, under a watermark: state expires on the arrival clock, and since
    every row has just arrived, none is behind."""
    return (df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", clock_skew)
            .withColumn("_arrived_ms", F.unix_millis("_arrived")))


def _expire(state, arrived_ms: int | None, keep_ms: int) -> None:
    """Let the key's record go once nothing of the key has arrived for ``keep_ms``."""
    if arrived_ms is not None:
        state.setTimeoutTimestamp(max(arrived_ms + keep_ms, state.getCurrentWatermarkMs() + 1))


def _whole(values: np.ndarray, late: np.ndarray) -> pd.Series:
    """The counted rows' values in place, null for late rows."""
    out = pd.Series(pd.NA, index=range(len(late)), dtype="Int64")
    out[~late] = values
    return out


def _anchored_state_fn(window_us: int, key: str, tie: str, lateness_us: int, keep_ms: int, extra=()):
    """W1 per key, chunk by chunk, state (anchor, n, newest time); ``extra`` columns ride along with their rows."""
    def fn(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        anchor, n, seen = state.get if state.exists else (None, None, None)
        carry = None if anchor is None else (anchor, n)
        arrived = None
        for pdf, late, seen in _chunks(batches, tie, seen, lateness_us):
            arrived = int(pdf["_arrived_ms"].max()) if len(pdf) else arrived
            ts = pdf["_ts_us"].to_numpy(dtype=np.int64)[~late]
            new = np.zeros(len(ts), dtype=bool)
            new[:1] = carry is None
            counts, anchors, carry = anchored_windows(ts, new, window_us, carry)
            out = {key: pdf[key].to_numpy(), tie: pdf[tie].to_numpy(), "window_count": _whole(counts, late),
                   "anchor_us": _whole(anchors, late), "late": late}
            out.update({c: pdf[c].to_numpy() for c in extra})
            yield pd.DataFrame(out)
        state.update((*(carry or (None, None)), seen))
        _expire(state, arrived, keep_ms)
    return fn


def _collected(batches, rows: int):
    """A group's Arrow batches put together to chunks of about ``rows`` rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _ttl_state_fn(ttl_us: int | None, key: str, tie: str, lateness_us: int, keep_ms: int, chunk_rows: int):
    """W3 for the keys of a bucket together, chunk by chunk, state (keys; last, n, newest time and last arrival of each).

    A key's numbers leave the bucket's record as a record of its own would; without a ttl they never do.
    """
    def put(state, keys, nums):
        if ttl_us is not None:
            held = nums[3] + keep_ms >= state.getCurrentWatermarkMs()
            keys, nums = keys[held], nums[:, held]
            if not len(keys):
                state.remove()
                return
        state.update((keys.tolist(), *nums.tolist()))
        if ttl_us is not None:
            _expire(state, int(nums[3].min()), keep_ms)

    def fn(k, batches, state):
        keys, *nums = state.get if state.exists else ([], [], [], [], [])
        keys, nums = np.array(keys, dtype=object), np.array(nums, dtype=np.int64)
        if state.hasTimedOut:
            put(state, keys, nums)
            return
        for pdf in _collected(batches, chunk_rows):
            known = len(keys)
            code, keys = pd.factorize(np.concatenate([keys, pdf[key].to_numpy(dtype=object)]), use_na_sentinel=False)
            keys[pd.isna(keys)] = None
            last, n, seen, arrived = (np.pad(x, (0, len(keys) - known)) for x in nums)
            pdf = pdf.assign(_code=code[known:]).sort_values(["_code", "_ts_us", "_no_tie", tie], kind="stable")
            code = pdf["_code"].to_numpy()
            arrived_ms = int(pdf["_arrived_ms"].max())
            arrived[code] = arrived_ms if ttl_us is None else max(arrived_ms, state.getCurrentWatermarkMs())
            ts = pdf["_ts_us"].fillna(0).to_numpy(dtype=np.int64)
            late = pdf["_ts_us"].isna().to_numpy() | ((n[code] > 0) & (ts < seen[code] - lateness_us))
            ts, code = ts[~late], code[~late]
            seen[code[n[code] == 0]] = np.iinfo(np.int64).min          # the first rows of a key
            np.maximum.at(seen, code, ts)
            counts, last, n = refreshed_counters(ts, code, last, n, ttl_us)
            nums = np.stack([last, n, seen, arrived])
            yield pd.DataFrame({key: pdf[key].to_numpy(), tie: pdf[tie].to_numpy(), "_no_tie": pdf["_no_tie"].to_numpy(),
                                "counter": _whole(counts, late), "late": late})
        put(state, keys, nums)
    return fn


def split_late(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that were counted or need no count, late rows) of a stream's output."""
    return decided.filter(~F.col("late")), decided.filter("late")


def stream_rate_limit(requests: DataFrame, config: DataFrame, window_s: int = K.RATE_WINDOW_SECONDS,
                      key: str = "tenant_id", tie: str = "request_id", lateness: str = LATENESS, keep: str = KEEP,
                      clock_skew: str = CLOCK_SKEW) -> DataFrame:
    """ST1 + ST4: streaming W1. ``requests`` is a streaming DataFrame (key, tie, ts).

    Late rows have a true ``late`` and no count, window or verdict.
    """
    from tokenledger.operators.tenants import with_tenant_config
    j = with_tenant_config(requests, config)
    j = j.withColumn("_ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    limited = j.filter(F.col("limit_rpm") > 0)
    counted = _on_arrival(limited.select(key, tie, "_ts_us"), clock_skew).groupBy(key).applyInPandasWithState(
        _anchored_state_fn(window_s * US, key, tie, interval_us(lateness), interval_us(keep) // 1000),
        outputStructType=StructType([j.schema[key], j.schema[tie], *_COUNTED]),
        stateStructType="anchor long, n long, seen long", outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)
    # stream-stream join avoided: the per-request limit is recomputed from the
    # config (a static broadcast lookup) on the counted output
    cfg_cols = with_tenant_config(counted, config)
    out = cfg_cols.select(key, tie, "limit_rpm", "window_count",
                          F.timestamp_micros("anchor_us").alias("window_start"),
                          (F.col("window_count") <= F.col("limit_rpm")).alias("allowed"), "late")
    bypass = j.filter(F.col("limit_rpm") <= 0).select(
        key, tie, "limit_rpm", F.lit(0).cast("bigint").alias("window_count"),
        F.lit(None).cast("timestamp").alias("window_start"), F.lit(True).alias("allowed"), F.lit(False).alias("late"))
    return out.unionByName(bypass)


def stream_admission(requests: DataFrame, config: DataFrame, window_s: int = K.RATE_WINDOW_SECONDS,
                     key: str = "tenant_id", tie: str = "request_id", lateness: str = LATENESS, keep: str = KEEP,
                     clock_skew: str = CLOCK_SKEW) -> DataFrame:
    """ST1 (+ST4): admission over a request stream.

    ``requests`` is a streaming DataFrame with key, tie, ``ts``, ``stream`` and
    ``messages`` (and optionally ``tools``). Stream-static join to the tenant
    config (J1); the message scan (P8), system prompt isolation (P11, then P6
    prompt text) and tool scoping (P10) are column expressions evaluated before
    the keyed W1 state and carried through it; P16 decides. Streamed requests
    (501) never reach the counter; tenants with limit <= 0 bypass it. Late
    requests are marked ``late`` and have a status of their own (408).
    """
    from tokenledger.functions.injection import scan_messages
    from tokenledger.functions.messages import isolate_system_prompt, prompt_text
    from tokenledger.operators.admission import admission_decision
    from tokenledger.operators.tenants import scope_tools, with_tenant_config
    j = with_tenant_config(requests, config)
    j = j.select(key, tie, F.coalesce(F.col("stream"), F.lit(False)).alias("stream"), "limit_rpm",
                 F.unix_micros(F.col("ts").cast("timestamp")).alias("_ts_us"),
                 scan_messages("messages").alias("scan_hit"),
                 prompt_text(isolate_system_prompt("messages", "system_prompt_override")).alias("prompt_text"),
                 (scope_tools(tools="tools") if "tools" in requests.columns
                  else F.lit(None).cast("string")).alias("tools"))
    extra = ["stream", "limit_rpm", "scan_hit", "prompt_text", "tools"]
    base = j.filter(~F.col("stream"))
    state_out = StructType([j.schema[key], j.schema[tie], *_COUNTED, *[j.schema[c] for c in extra]])
    counted = (_on_arrival(base.filter(F.col("limit_rpm") > 0), clock_skew).groupBy(key).applyInPandasWithState(
        _anchored_state_fn(window_s * US, key, tie, interval_us(lateness), interval_us(keep) // 1000, extra),
        outputStructType=state_out, stateStructType="anchor long, n long, seen long", outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)
        .withColumn("allowed", F.col("window_count") <= F.col("limit_rpm"))
        .withColumn("window_start", F.timestamp_micros("anchor_us")).drop("anchor_us"))
    bypass = (base.filter(F.col("limit_rpm") <= 0).drop("_ts_us").withColumn("late", F.lit(False))
              .withColumn("window_count", F.lit(0).cast("bigint")).withColumn("allowed", F.lit(True))
              .withColumn("window_start", F.lit(None).cast("timestamp")))
    streamed = (j.filter(F.col("stream")).drop("_ts_us").withColumn("late", F.lit(False))
                .withColumn("window_count", F.lit(None).cast("bigint"))
                .withColumn("allowed", F.lit(None).cast("boolean"))
                .withColumn("window_start", F.lit(None).cast("timestamp")))
    decided = admission_decision(counted.unionByName(bypass).unionByName(streamed))
    return decided.withColumns({"status": F.when(F.col("late"), F.lit(LATE_STATUS)).otherwise(F.col("status")),
                                "reason": F.when(F.col("late"), F.lit(LATE_REASON)).otherwise(F.col("reason"))})


def stream_ttl_counter(events: DataFrame, key: str, ttl_s: int | None, tie: str = "event_id",
                       lateness: str = LATENESS, keep: str = KEEP, clock_skew: str = CLOCK_SKEW,
                       buckets: int = COUNTER_BUCKETS, chunk_rows: int = COUNTER_ROWS) -> DataFrame:
    """ST5: streaming W3, one counter value per event (none for late ones, which are marked).

    Keys are counted by buckets of their hash, a bucket's keys in one call: a micro-batch costs by its rows, not by a
    Python call for each key in it. ``buckets`` belongs to the state and stays for the life of a checkpoint.
    """
    kind = events.schema[tie].dataType
    # whole numbers pass through pandas without nulls, which would make them floats
    tied = F.coalesce(F.col(tie), F.lit(0).cast(kind)) if isinstance(kind, IntegralType) else F.col(tie)
    e = events.select(F.col(key).cast("string").alias(key), tied.alias(tie), F.col(tie).isNull().alias("_no_tie"),
                      F.unix_micros(F.col("ts").cast("timestamp")).alias("_ts_us"),
                      F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("_bucket"))
    timeout = GroupStateTimeout.NoTimeout if ttl_s is None else GroupStateTimeout.EventTimeTimeout
    keep_ms = max(interval_us(keep), 2 * US * (ttl_s or 0)) // 1000
    counted = _on_arrival(e, clock_skew).groupBy("_bucket").applyInPandasWithState(
        _ttl_state_fn(None if ttl_s is None else ttl_s * US, key, tie, interval_us(lateness), keep_ms, chunk_rows),
        outputStructType=StructType([StructField(key, StringType()), StructField(tie, kind), StructField("_no_tie", BooleanType()),
                                     StructField("counter", LongType()), StructField("late", BooleanType())]),
        stateStructType="keys array<string>, last array<long>, n array<long>, seen array<long>, arrived array<long>",
        outputMode="append", timeoutConf=timeout)
    return counted.select(key, F.when(~F.col("_no_tie"), F.col(tie)).alias(tie), "counter", "late")


def stream_sessions(events: DataFrame, key: str, ttl_s: int, lateness: str = LATENESS) -> DataFrame:
    """ST5 as sessions: (key, session_start, session_end, events), a row for each run of events no more than
    ``ttl_s`` apart, once the watermark has passed its end.

    ``session_end`` is the last event's time. Spark keeps the open sessions as state and drops events that come
    later than ``lateness``; ``stream_ttl_counter`` keeps a row for each event.
    """
    # a session window ends, exclusive, one gap after its last event; a pause of exactly ttl_s still belongs to it
    gap = ttl_s * US + 1
    timed = events.select(F.col(key).cast("string").alias(key), F.col("ts").cast("timestamp").alias("ts"))
    held = timed.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", f"{gap} microseconds").alias("w"))
    return held.agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("w.start").alias("session_start"),
        F.timestamp_micros(F.unix_micros("w.end") - F.lit(gap)).alias("session_end"), "events")


def stream_usage_updates(audit_stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """ST3 in update mode: the rollup (A1) as a streaming aggregate over days of event time.

    Every micro-batch puts out the keys it changed with their new totals. A day leaves the state once the watermark
    (``lateness`` behind the newest row) has passed its end; rows for a day that has left are dropped by Spark, so
    where every row must count, ``run_usage_upserts`` is the job to use.
    """
    from tokenledger.operators.rollup import rollup_aggregates
    day = F.window("created_at", "1 day").alias("_day")
    return (audit_stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
            .groupBy("tenant_id", day, "provider").agg(*rollup_aggregates())
            .select("tenant_id", F.to_date("_day.start").alias("date"), "provider", *ROLLUP_COUNTERS))


# ------------------------------------------------------------------ runners
def run_to_parquet(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to completion (availableNow) into a fresh folder under the
    shared checkpoint directory and return the written table."""
    base = scratch_path(spark, f"streams/{name}/{uuid.uuid4().hex}")
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start(f"{base}/out"))
    run_available(q)
    return spark.read.parquet(f"{base}/out")


def run_usage_updates(audit_stream: DataFrame, spark: SparkSession, name: str, lateness: str = LATENESS
                      ) -> tuple[DataFrame, list[int]]:
    """Run ``stream_usage_updates`` to the end: (the last totals of every key, state rows after each batch).

    A batch overwrites its own folder, so a retried one leaves the same rows.
    """
    base = scratch_path(spark, f"streams/{name}/{uuid.uuid4().hex}")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint")).write.mode("overwrite").parquet(f"{base}/b={batch_id}")

    q = (stream_usage_updates(audit_stream, lateness).writeStream.foreachBatch(each).outputMode("update")
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    run_available(q)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    latest = F.max_by(F.struct(*ROLLUP_COUNTERS), "batch_id").alias("_c")
    rows = spark.read.parquet(f"{base}/b=*").groupBy("tenant_id", "date", "provider").agg(latest)
    return rows.select("tenant_id", "date", "provider", "_c.*"), held


def run_usage_upserts(audit_stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """ST3: every micro-batch's rollup delta is upserted (S5); returns the usage table."""
    from tokenledger.operators.rollup import usage_rollup
    from tokenledger.sources.sinks import read_usage, upsert_usage
    base = scratch_path(spark, f"streams/{name}/{uuid.uuid4().hex}")

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_usage(spark, usage_rollup(batch), f"{base}/deltas", f"{base}/usage", batch_id)

    q = (audit_stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    run_available(q)
    return read_usage(spark, f"{base}/usage", f"{base}/deltas")
