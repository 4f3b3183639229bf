"""Attempt resolution and audit rows.

An attempt table holds one row per provider call (attempt 1 = requested model,
attempt 2 = one-hop fallback). Resolution groups by request_id; a request has
at most two attempts, so every group is bounded and the aggregate is a plain
hash aggregate on a uniformly distributed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.pricing import cost_usd
from tokenledger.functions.routing import provider_of

ATTEMPT_FIELDS = ["provider", "model", "ok", "error", "latency_ms", "prompt_tokens", "completion_tokens"]


def resolve_attempts(attempts: DataFrame, keep=("tenant_id", "ts")) -> DataFrame:
    """One row per request with its outcome.

    primary       attempt 1 succeeded
    fallback      attempt 1 failed, attempt 2 succeeded (error cleared)
    rejected_502  both failed: no audit row
    error_logged  attempt 1 failed, no fallback: audit row with the error, 0 tokens

    Latency spans every attempt of the request.
    """
    rec = F.struct(*[F.col(c) for c in ATTEMPT_FIELDS])
    keep = [c for c in keep if c in attempts.columns]
    agg = (attempts.groupBy("request_id")
           .agg(*[F.first(c).alias(c) for c in keep],
                F.min_by(rec, F.col("attempt_no")).alias("a1"),
                F.max_by(rec, F.col("attempt_no")).alias("last"),
                F.count(F.lit(1)).alias("n_attempts"),
                F.sum("latency_ms").cast("int").alias("latency_total")))
    a1, last = F.col("a1"), F.col("last")
    outcome = (F.when(a1["ok"], F.lit("primary"))
                .when((F.col("n_attempts") > 1) & last["ok"], F.lit("fallback"))
                .when(F.col("n_attempts") > 1, F.lit("rejected_502"))
                .otherwise(F.lit("error_logged")))
    used = F.when(outcome == "fallback", last).otherwise(a1)
    tokens_ok = outcome.isin("primary", "fallback")
    return agg.select(
        "request_id", *keep, outcome.alias("outcome"),
        a1["provider"].alias("provider"),
        used["model"].alias("used_model"),
        F.when(tokens_ok, used["prompt_tokens"]).otherwise(F.lit(0)).cast("int").alias("prompt_tokens"),
        F.when(tokens_ok, used["completion_tokens"]).otherwise(F.lit(0)).cast("int").alias("completion_tokens"),
        F.col("latency_total").alias("latency_ms"),
        F.when(outcome == "error_logged", a1["error"])
         .when(outcome == "rejected_502", last["error"]).alias("error"),
    )


def provider_audit_rows(resolved: DataFrame) -> DataFrame:
    """P18 (provider rows) + P19: audit rows for every outcome but 502.

    provider = provider of the *requested* model; model = model finally used;
    cost priced by the used model's own provider table (D10).
    """
    r = resolved.filter(F.col("outcome") != "rejected_502")
    return r.select(
        "request_id", F.col("ts").alias("created_at"), "tenant_id",
        F.lit(None).cast("string").alias("user_id"),
        "provider", F.col("used_model").alias("model"),
        "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        "latency_ms",
        cost_usd(provider_of("used_model"), "used_model", "prompt_tokens", "completion_tokens").alias("cost_usd"),
        F.lit(False).alias("cache_hit"),
        F.when(F.col("outcome") == "error_logged", F.col("error")).alias("error_message"),
    )


def cache_audit_rows(hits: DataFrame, model_col: str = "model") -> DataFrame:
    """P18 (cache rows): provider 'cache', tokens 0, latency and cost null,
    model = requested model."""
    return hits.select(
        "request_id", F.col("ts").alias("created_at"), "tenant_id",
        F.lit(None).cast("string").alias("user_id"),
        F.lit("cache").alias("provider"), F.col(model_col).alias("model"),
        F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), F.lit(0).alias("total_tokens"),
        F.lit(None).cast("int").alias("latency_ms"), F.lit(None).cast("decimal(12,6)").alias("cost_usd"),
        F.lit(True).alias("cache_hit"), F.lit(None).cast("string").alias("error_message"),
    )


def audit_rows(resolved: DataFrame, cache_hits: DataFrame | None = None) -> DataFrame:
    """Provider rows unioned with cache-hit rows, plus the audit date."""
    rows = provider_audit_rows(resolved)
    if cache_hits is not None:
        rows = rows.unionByName(cache_audit_rows(cache_hits))
    return rows.withColumn("event_date", F.to_date("created_at"))


def cacheable_flag(outcome: str = "outcome", prompt: str = "prompt_text", include_errors: bool = False):
    """P21 as a column: non-empty prompt text and a cached outcome."""
    ok = ["primary", "fallback"] + (["error_logged"] if include_errors else [])
    return F.coalesce(F.col(outcome).isin(*ok) & (F.length(F.col(prompt)) > 0), F.lit(False))

