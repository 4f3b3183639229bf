"""Usage rollup (A1), incremental merge (A5, S5, J7) and drift check.

All three are sums keyed by (tenant_id, date, provider): Spark plans them as a
partial HashAggregate before the shuffle and a final one after, so only one
row per key per map partition crosses the network, whatever the key skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.pricing import COST_SUM_TYPE
from tokenledger.functions.text import is_falsy_str

KEYS = ["tenant_id", "date", "provider"]
COUNTERS = ["total_requests", "total_prompt_tokens", "total_completion_tokens",
            "total_cost_usd", "cache_hits", "errors"]


def rollup_aggregates() -> list[Column]:
    """A1's counters over audit rows.

    Null cost counts as 0; an error counts when the message is truthy (an empty
    string is not an error here, unlike the dashboard's IS NOT NULL).
    """
    return [F.count(F.lit(1)).alias("total_requests"),
            F.sum("prompt_tokens").cast("bigint").alias("total_prompt_tokens"),
            F.sum("completion_tokens").cast("bigint").alias("total_completion_tokens"),
            F.sum(F.coalesce(F.col("cost_usd"), F.lit(0).cast("decimal(12,6)")))
             .cast(COST_SUM_TYPE).alias("total_cost_usd"),
            F.count_if(F.col("cache_hit")).alias("cache_hits"),
            F.count_if(~is_falsy_str("error_message")).alias("errors")]


def usage_rollup(audit: DataFrame) -> DataFrame:
    """A1: fold audit rows into (tenant_id, date, provider) counters."""
    return audit.groupBy("tenant_id", F.to_date("created_at").alias("date"), "provider").agg(*rollup_aggregates())


def merge_rollup(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Add delta counters to the existing rollup, key by key.

    ``unionByName`` + re-aggregation: cheaper than a full outer join, and it
    keeps keys present on only one side.
    """
    cols = KEYS + COUNTERS
    return (existing.select(*cols).unionByName(delta.select(*cols))
            .groupBy(*KEYS)
            .agg(F.sum("total_requests").cast("bigint").alias("total_requests"),
                 F.sum("total_prompt_tokens").cast("bigint").alias("total_prompt_tokens"),
                 F.sum("total_completion_tokens").cast("bigint").alias("total_completion_tokens"),
                 F.sum("total_cost_usd").cast(COST_SUM_TYPE).alias("total_cost_usd"),
                 F.sum("cache_hits").cast("bigint").alias("cache_hits"),
                 F.sum("errors").cast("bigint").alias("errors")))


def rollup_drift(audit: DataFrame, usage: DataFrame) -> DataFrame:
    """Rows where the stored rollup and the rollup of the facts disagree.

    ``side='facts'`` rows are in the recomputed rollup but not stored,
    ``side='stored'`` rows the other way round (both ``EXCEPT ALL``). One
    aggregate instead of two set differences: every row counts +1 from the
    facts and -1 from the store, grouped on all columns (nulls compare equal,
    as in ``EXCEPT ALL``), and a non-zero net is emitted |net| times.
    """
    cols = KEYS + COUNTERS
    facts = usage_rollup(audit).select(*cols, F.lit(1).alias("_d"))
    stored = usage.select(*cols, F.lit(-1).alias("_d"))
    net = (facts.unionByName(stored).groupBy(*cols).agg(F.sum("_d").alias("_net"))
           .filter(F.col("_net") != 0))
    return net.select(*cols, F.when(F.col("_net") > 0, F.lit("facts")).otherwise(F.lit("stored")).alias("side"),
                      F.explode(F.array_repeat(F.lit(0), F.abs(F.col("_net")).cast("int"))).alias("_rep")) \
              .drop("_rep")
