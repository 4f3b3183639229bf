"""Dashboard queries (P20 usage range, A2 latency, A3 cache hit rate, A4 errors).

``as_of`` is always an explicit date, never the wall clock. Filters are plain
column predicates so they reach the Parquet scan (and prune ``event_date``
partitions when the audit table is written partitioned). ``orderBy + limit``
plans as TakeOrderedAndProject: a per-partition top-k, then one small merge.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger import constants as K
from tokenledger.functions.timeutil import ts_lit


def _check_range(name: str, value: int, bounds: tuple[int, int]) -> None:
    lo, hi = bounds
    if not (lo <= value <= hi):
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value}")


def _as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.datetime.fromisoformat(str(as_of)).date()     # "YYYY-MM-DD" or a full timestamp


def usage_range(usage: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """P20 + T1: rollup rows with as_of - days <= date <= as_of (days + 1 dates)."""
    _check_range("days", days, K.USAGE_DAYS_RANGE)
    end = _as_date(as_of)
    start = end - dt.timedelta(days=days)
    df = usage.filter((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(end)))
    if tenant_id:
        df = df.filter(F.col("tenant_id") == tenant_id)
        order = [F.desc("date"), "provider"]
    else:
        order = [F.desc("date"), "tenant_id", "provider"]
    return df.select("tenant_id", "date", "provider", "total_requests", "total_prompt_tokens",
                     "total_completion_tokens", "total_cost_usd", "cache_hits", "errors").orderBy(*order)


def latency(audit: DataFrame, tenant_id: str | None = None, provider: str | None = None,
            limit: int = 100) -> DataFrame:
    """A2 + T2: average latency and request count per (provider, model).

    Rows with null latency (cache hits) are excluded; no date filter. Each given
    filter is applied (deviations D1, D2); output ordered by provider, model (D3).
    """
    _check_range("limit", limit, K.LATENCY_LIMIT_RANGE)
    df = audit.filter(F.col("latency_ms").isNotNull())
    if tenant_id:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if provider:
        df = df.filter(F.col("provider") == provider)
    return (df.groupBy("provider", "model")
            .agg(F.avg("latency_ms").cast("double").alias("avg_latency_ms"),
                 F.count(F.lit(1)).alias("request_count"))
            .orderBy("provider", "model").limit(limit))


def cache_stats(audit: DataFrame, as_of, days: int = 7, tenant_id: str | None = None) -> DataFrame:
    """A3: one row (cache_hits, total_requests, hit_rate_pct) over created_at >=
    as_of - days (no upper bound). Rate is hits*100/total rounded half-up to 2
    places, 0 when there are no rows (D9)."""
    _check_range("days", days, K.USAGE_DAYS_RANGE)
    start = _as_date(as_of) - dt.timedelta(days=days)
    df = audit.filter(F.col("created_at") >= ts_lit(start))
    if "event_date" in audit.columns:
        # same rows (event_date = UTC date of created_at); lets a table written
        # partitioned by event_date skip whole partitions
        df = df.filter(F.col("event_date") >= F.lit(start))
    if tenant_id:
        df = df.filter(F.col("tenant_id") == tenant_id)
    agg = df.agg(F.count_if(F.col("cache_hit")).alias("cache_hits"),
                 F.count(F.lit(1)).alias("total_requests"))
    rate = F.when(F.col("total_requests") == 0, F.lit(0.0)).otherwise(
        F.round(F.col("cache_hits").cast("decimal(20,0)") * 100 / F.col("total_requests"), 2).cast("double"))
    return agg.select("cache_hits", "total_requests", rate.alias("hit_rate_pct"))


def errors(audit: DataFrame, tenant_id: str | None = None, provider: str | None = None,
           limit: int = 50) -> DataFrame:
    """A4 + T2: error count per (provider, model) where error_message IS NOT NULL
    (an empty string counts here). Provider filter applied when given (D2)."""
    _check_range("limit", limit, K.ERRORS_LIMIT_RANGE)
    df = audit.filter(F.col("error_message").isNotNull())
    if tenant_id:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if provider:
        df = df.filter(F.col("provider") == provider)
    return (df.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("error_count"))
            .orderBy("provider", "model").limit(limit))
