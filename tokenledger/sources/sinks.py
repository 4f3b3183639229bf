"""Sinks: audit append (S4) and rollup upsert (S5) on plain Parquet.

Parquet has no MERGE, so the rollup is kept exactly-once without one:

* each micro-batch's delta is written to ``deltas/batch_id=B`` with dynamic
  partition overwrite -- a retried batch rewrites its own partition and never
  adds twice. That is all the work of most batches, whatever came before;
* every ``fold_every`` batches the deltas since the last fold are added to the
  base of the dates they touch, as ``usage/upto=B/date=D``; other dates are not
  read;
* a fold ends with a manifest, ``usage/_manifest/v=B``: which fold holds each
  date's base. It counts once its ``_SUCCESS`` file stands, so readers see the
  old state or the new one. A fold reads the manifest before it and writes under
  its own number only, so a retried fold gives the same files;
* bases that neither this manifest nor the one before names, deltas that the one
  before had folded, and older manifests are then removed. So what a batch or a
  reader lists and reads follows the number of dates and ``fold_every``, not the
  history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.pricing import COST_SUM_TYPE
from tokenledger.operators.rollup import COUNTERS, KEYS, merge_rollup
from tokenledger.sources.folders import numbered as _numbered, remove as _remove

FOLD_EVERY = 16
_ROLLUP = ("tenant_id string, date date, provider string, total_requests long, total_prompt_tokens long, "
           f"total_completion_tokens long, total_cost_usd {COST_SUM_TYPE}, cache_hits long, errors long")


def append_audit(audit: DataFrame, path: str) -> None:
    """Append audit rows partitioned by event date (partition pruning for
    the dashboard's date ranges)."""
    df = audit if "event_date" in audit.columns else audit.withColumn("event_date", F.to_date("created_at"))
    df.write.mode("append").partitionBy("event_date").parquet(path)


def audit_stream_sink(audit_stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """S4 / ST2: streaming file sink; exactly-once via the checkpoint and the
    sink's own commit log."""
    df = audit_stream.withColumn("event_date", F.to_date("created_at"))
    w = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .partitionBy("event_date"))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start(path)


def _manifest(spark: SparkSession, usage_path: str, before: int | None = None) -> tuple[int, dict]:
    """(number, {date: fold that holds its base}) of the last manifest (before a batch); (-1, {}) if there is none."""
    known = [v for v in _numbered(spark, f"{usage_path}/_manifest", "v", committed=True) if before is None or v < before]
    if not known:
        return -1, {}
    rows = spark.read.schema("date date, upto long").parquet(f"{usage_path}/_manifest/v={known[-1]}").collect()   # a row a date
    return known[-1], {r["date"]: r["upto"] for r in rows}


def _base_folder(usage_path: str, date, upto: int) -> str:
    return f"{usage_path}/upto={upto}/date={'__HIVE_DEFAULT_PARTITION__' if date is None else date.isoformat()}"


def _bases(spark: SparkSession, usage_path: str, held: dict) -> DataFrame:
    """The bases that a manifest names, read by their folders."""
    if not held:
        return spark.createDataFrame([], _ROLLUP)
    paths = [_base_folder(usage_path, date, upto) for date, upto in held.items()]
    return (spark.read.schema(f"{_ROLLUP}, upto long").option("basePath", usage_path).parquet(*paths)
            .select(*KEYS, *COUNTERS))


def _deltas(spark: SparkSession, deltas_path: str, after: int, upto: int | None = None) -> DataFrame:
    """The deltas behind a fold, up to a batch."""
    ids = [b for b in _numbered(spark, deltas_path, "batch_id") if b > after and (upto is None or b <= upto)]
    if not ids:
        return spark.createDataFrame([], _ROLLUP)
    paths = [f"{deltas_path}/batch_id={b}" for b in ids]
    return spark.read.schema(_ROLLUP).parquet(*paths).select(*KEYS, *COUNTERS)


def upsert_usage(spark: SparkSession, delta: DataFrame, deltas_path: str, usage_path: str, batch_id: int,
                 fold_every: int = FOLD_EVERY) -> None:
    """Add a rollup delta to the usage table, idempotently per batch_id."""
    # per-write option: foreachBatch runs on a cloned session, so a session conf set here would not apply
    (delta.select(*KEYS, *COUNTERS).withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(deltas_path))
    if (batch_id + 1) % fold_every:
        return
    last, held = _manifest(spark, usage_path, batch_id)
    news = _deltas(spark, deltas_path, last, batch_id)
    touched = {r["date"] for r in news.select("date").distinct().collect()}                     # a row a date
    old = _bases(spark, usage_path, {d: v for d, v in held.items() if d in touched})
    merge_rollup(old, news).write.mode("overwrite").partitionBy("date").parquet(f"{usage_path}/upto={batch_id}")
    now = {**held, **{d: batch_id for d in touched}}
    (spark.createDataFrame(list(now.items()), "date date, upto long").coalesce(1)
     .write.mode("overwrite").parquet(f"{usage_path}/_manifest/v={batch_id}"))
    _clean_up(spark, deltas_path, usage_path, last, held, now)


def _clean_up(spark: SparkSession, deltas_path: str, usage_path: str, last: int, held: dict, now: dict) -> None:
    """Remove what neither the last two manifests nor a retry of the last fold can read."""
    older, before = _manifest(spark, usage_path, last)
    for date, upto in before.items():
        if upto not in (held.get(date), now.get(date)):
            _remove(spark, _base_folder(usage_path, date, upto))
    for v in {u for u in before.values()} - {*held.values(), *now.values()}:
        _remove(spark, f"{usage_path}/upto={v}")
    for b in _numbered(spark, deltas_path, "batch_id"):
        if b <= last:
            _remove(spark, f"{deltas_path}/batch_id={b}")
    for v in _numbered(spark, f"{usage_path}/_manifest", "v"):
        if v < last:
            _remove(spark, f"{usage_path}/_manifest/v={v}")


def read_usage(spark: SparkSession, usage_path: str, deltas_path: str) -> DataFrame:
    """The usage table: each date's base plus the deltas behind the last fold."""
    last, held = _manifest(spark, usage_path)
    return merge_rollup(_bases(spark, usage_path, held), _deltas(spark, deltas_path, last))
