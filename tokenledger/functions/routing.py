"""Provider routing, fallback lookup and outbound payload shaping.

All of these are plain Catalyst expressions: they fuse into whole-stage
codegen next to the scan, with no join and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def provider_of(model) -> Column:
    """``claude-`` prefix (case-sensitive) routes to anthropic, all else to openai."""
    return F.when(_col(model).startswith(K.ANTHROPIC_PREFIX), F.lit("anthropic")).otherwise(F.lit("openai"))


def _string_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def fallback_model(provider, model) -> Column:
    """One-hop fallback for (provider, model); null when there is none."""
    p, m = _col(provider), _col(model)
    return (F.when(p == "openai", F.element_at(_string_map(K.OPENAI_FALLBACK), m))
             .when(p == "anthropic", F.element_at(_string_map(K.ANTHROPIC_FALLBACK), m)))


def fallback_table(spark):
    """P2 in table form, for callers that join instead of using the expression."""
    rows = [("openai", m, f) for m, f in K.OPENAI_FALLBACK.items()]
    rows += [("anthropic", m, f) for m, f in K.ANTHROPIC_FALLBACK.items()]
    return spark.createDataFrame(rows, "provider string, model string, fallback_model string")


def falsy_int_default(c, default: int) -> Column:
    """``x or default`` for an int: null and 0 both take the default."""
    c = _col(c)
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def payload_b(model, system, messages, temperature, max_tokens) -> Column:
    """P13, provider B: max_tokens falls back to 1024 (0 too), system ``''`` if
    empty, temperature only when set (``to_json`` drops null fields)."""
    return F.to_json(F.struct(
        _col(model).alias("model"),
        falsy_int_default(max_tokens, K.DEFAULT_MAX_TOKENS_B).alias("max_tokens"),
        F.coalesce(_col(system), F.lit("")).alias("system"),
        _col(messages).alias("messages"),
        F.lit(K.PROVIDER_TIMEOUT_S).alias("timeout"),
        _col(temperature).alias("temperature"),
    ))


def payload_a(model, messages, temperature, max_tokens, stream=None) -> Column:
    """P13, provider A: temperature and max_tokens only when not null."""
    return F.to_json(F.struct(
        _col(model).alias("model"),
        _col(messages).alias("messages"),
        (F.coalesce(_col(stream), F.lit(False)) if stream is not None else F.lit(False)).alias("stream"),
        F.lit(K.PROVIDER_TIMEOUT_S).alias("timeout"),
        _col(temperature).alias("temperature"),
        _col(max_tokens).alias("max_tokens"),
    ))
