"""Tenant configuration: lookup (S3/J1), tool scoping (P10), seed-if-absent
(S6/J6) and column defaults (S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger import constants as K
from tokenledger.operators.dimensions import fits_broadcast, lookup_join

CONFIG_COLS = ["rate_limit_rpm", "allowed_models", "allow_tool_calls", "system_prompt_override"]


def with_tenant_config(requests: DataFrame, config: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Attach the tenant row (if any) and a ``cfg_present`` flag.

    The config table is broadcast only when it is measured to be small; the effective limit is the configured one, 60 when absent or null (D6).
    """
    cols = [c for c in CONFIG_COLS if c in config.columns]
    cfg = config.select("tenant_id", *cols).withColumn("cfg_present", F.lit(True))
    out = lookup_join(requests, cfg, "tenant_id", "left", max_rows=max_rows)
    return (out.withColumn("cfg_present", F.coalesce(F.col("cfg_present"), F.lit(False)))
               .withColumn("limit_rpm", F.coalesce(F.col("rate_limit_rpm"), F.lit(K.DEFAULT_RATE_LIMIT_RPM))))


def scope_tools(cfg_present="cfg_present", allow="allow_tool_calls", tools="tools"):
    """P10: no config -> keep; allow flag false *or null* -> null; else keep."""
    keep = (~F.col(cfg_present)) | F.coalesce(F.col(allow), F.lit(False))
    return F.when(keep, F.col(tools))


#: Column types and defaults of the stored tables (None: no default, so null)
TENANT_DEFAULTS = {
    "rate_limit_rpm": ("int", lambda: F.lit(K.DEFAULT_RATE_LIMIT_RPM)),
    "allowed_models": ("array<string>", lambda: F.array(*[F.lit(m) for m in K.DEFAULT_ALLOWED_MODELS])),
    "allow_tool_calls": ("boolean", lambda: F.lit(True)),
    "system_prompt_override": ("string", None),
    "created_at": ("timestamp", F.current_timestamp),
    "updated_at": ("timestamp", F.current_timestamp),
}
AUDIT_DEFAULTS = {
    "created_at": ("timestamp", F.current_timestamp),
    "user_id": ("string", None),
    "latency_ms": ("int", None),
    "cost_usd": ("decimal(12,6)", None),
    "cache_hit": ("boolean", lambda: F.lit(False)),
    "error_message": ("string", None),
}
USAGE_DEFAULTS = {
    "total_requests": ("bigint", lambda: F.lit(0)),
    "total_prompt_tokens": ("bigint", lambda: F.lit(0)),
    "total_completion_tokens": ("bigint", lambda: F.lit(0)),
    "total_cost_usd": ("decimal(22,6)", lambda: F.lit(0)),
    "cache_hits": ("bigint", lambda: F.lit(0)),
    "errors": ("bigint", lambda: F.lit(0)),
}


def conform(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns that an insert omits, with the table's defaults.

    As in SQL, a default fills an omitted column only; an explicit null stays.
    """
    missing = {c: (F.lit(None) if make is None else make()).cast(kind)
               for c, (kind, make) in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def conform_tenants(df: DataFrame) -> DataFrame:
    """S7 for the tenant configuration, without its two timestamps."""
    return conform(df, {c: d for c, d in TENANT_DEFAULTS.items() if not c.endswith("_at")})


def seed_if_absent(existing: DataFrame, seed: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Insert seed rows whose key is not already present (ON CONFLICT DO
    NOTHING) -- a left-anti join on the key, then a union."""
    seed = conform_tenants(seed).select(*existing.columns)
    seed_keys = seed.select(key)
    if fits_broadcast(seed_keys):
        # the seed is small: find which of its keys exist with one pass over
        # `existing` (no shuffle of the big side), then drop those seed rows
        present = existing.select(key).join(F.broadcast(seed_keys), key, "left_semi")
        return existing.unionByName(seed.join(present, key, "left_anti"))
    return existing.unionByName(seed.join(existing.select(key), key, "left_anti"))
