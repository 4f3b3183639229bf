"""TTL key-value table (S8 read, S9 write) -- the cache store as a table.

Writes are appended rows (key, value, written_at, ttl_seconds); a read at
``as_of`` sees, per key, the latest write if it has not expired. The latest
write per key is a ``max_by`` (partial aggregation before the shuffle, so a
hot key costs one row per map partition).

On disk the table is a log and a snapshot: ``kv_append`` writes a batch to
``log/batch_id=B``; ``kv_compact`` folds the snapshot and the log into
``snapshot/v=B``, each key's latest write, without those that had expired, and
removes what the snapshot before it had folded. A snapshot counts once its
``_SUCCESS`` file stands; a retried batch or compaction writes the same folder
again. ``kv_table`` reads the last snapshot and the log behind it, nothing older.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger import constants as K
from tokenledger.functions.timeutil import ts_lit
from tokenledger.sources.folders import numbered, remove


def kv_write(store: DataFrame | None, writes: DataFrame, value_col: str = "value", ttl_s: int | None = None,
             encode_json: bool = False) -> DataFrame:
    """Serialise (optionally with ``to_json``) and append; last write wins at read."""
    w = writes
    if encode_json:
        w = w.withColumn(value_col, F.to_json(F.col(value_col)))
    if "ttl_seconds" not in w.columns:
        w = w.withColumn("ttl_seconds", F.lit(ttl_s or K.RESPONSE_TTL_SECONDS))
    w = w.select("key", F.col(value_col).alias("value"), "written_at", "ttl_seconds",
                 *(["write_id"] if "write_id" in w.columns else []))
    return w if store is None else store.unionByName(w, allowMissingColumns=True)


def kv_latest_live(store: DataFrame, as_of) -> DataFrame:
    """Per key the latest write at or before ``as_of``, if still alive.

    Output: key, json (VARIANT, null when the value is not valid JSON), raw (the
    text when it is not JSON), written_at.
    """
    as_of_ts = ts_lit(as_of)
    order = F.struct("written_at", *(["write_id"] if "write_id" in store.columns else []))
    latest = (store.filter(F.col("written_at") <= as_of_ts)
              .groupBy("key")
              .agg(F.max_by(F.struct("value", "ttl_seconds", "written_at"), order).alias("w")))
    live = latest.filter(as_of_ts < F.col("w.written_at") + F.make_dt_interval(secs=F.col("w.ttl_seconds")))
    parsed = F.try_parse_json(F.col("w.value"))
    return live.select("key", parsed.alias("json"),
                       F.when(parsed.isNull(), F.col("w.value")).alias("raw"),
                       F.col("w.written_at").alias("written_at"))


_STORED = "key string, value string, written_at timestamp, ttl_seconds long, write_id long"


def _stored(rows: DataFrame) -> DataFrame:
    """The stored columns; writes without an id order by their time alone."""
    if "write_id" not in rows.columns:
        rows = rows.withColumn("write_id", F.lit(None))
    return rows.select("key", "value", F.col("written_at").cast("timestamp").alias("written_at"),
                       F.col("ttl_seconds").cast("bigint").alias("ttl_seconds"), F.col("write_id").cast("bigint").alias("write_id"))


def kv_append(spark: SparkSession, path: str, writes: DataFrame, batch_id: int, **options) -> None:
    """S9 on disk: a batch of writes (see ``kv_write``), once however often it is retried."""
    _stored(kv_write(None, writes, **options)).write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")


def _last_snapshot(spark: SparkSession, path: str, before: int | None = None) -> int:
    known = [v for v in numbered(spark, f"{path}/snapshot", "v", committed=True) if before is None or v < before]
    return known[-1] if known else -1


def _table(spark: SparkSession, path: str, snapshot: int, upto: int | None = None) -> DataFrame:
    paths = [f"{path}/snapshot/v={snapshot}"] if snapshot >= 0 else []
    paths += [f"{path}/log/batch_id={b}" for b in numbered(spark, f"{path}/log", "batch_id", committed=True)
              if b > snapshot and (upto is None or b <= upto)]
    return spark.read.schema(_STORED).parquet(*paths) if paths else spark.createDataFrame([], _STORED)


def kv_table(spark: SparkSession, path: str) -> DataFrame:
    """The writes that a read needs, for ``kv_latest_live``: the last snapshot and the batches behind it."""
    return _table(spark, path, _last_snapshot(spark, path))


def kv_compact(spark: SparkSession, path: str, as_of, batch_id: int) -> None:
    """Fold all batches up to ``batch_id`` into a snapshot for reads at ``as_of`` or later.

    It keeps each key's latest write at or before ``as_of`` unless that has expired, and all writes after ``as_of``;
    batches still to come must hold no write at or before ``as_of``.
    """
    last, at = _last_snapshot(spark, path, batch_id), ts_lit(as_of)
    rows = _table(spark, path, last, batch_id)
    order = F.struct("written_at", "write_id")
    latest = (rows.filter(F.col("written_at") <= at).groupBy("key")
              .agg(F.max_by(F.struct("value", "written_at", "ttl_seconds", "write_id"), order).alias("w")).select("key", "w.*")
              .filter(at < F.col("written_at") + F.make_dt_interval(secs=F.col("ttl_seconds"))))
    later = rows.filter((F.col("written_at") > at) | F.col("written_at").isNull())
    latest.unionByName(later).write.mode("overwrite").parquet(f"{path}/snapshot/v={batch_id}")
    for b in numbered(spark, f"{path}/log", "batch_id"):
        if b <= last:
            remove(spark, f"{path}/log/batch_id={b}")
    for v in numbered(spark, f"{path}/snapshot", "v"):
        if v < last:
            remove(spark, f"{path}/snapshot/v={v}")
