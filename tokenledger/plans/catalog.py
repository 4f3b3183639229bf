"""Named queries: each is a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the semantics are SQL-expressible, the equivalent DuckDB SQL over the
driver's views. Column names are aliased identically on both sides.

Every query reads whole driver tables (or data Spark derives from them).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger import constants as K
from tokenledger.functions.pricing import unit_prices, cost_usd
from tokenledger.functions.routing import fallback_model, provider_of
from tokenledger.operators import attempts as AT
from tokenledger.operators import dashboard as D
from tokenledger.operators import rollup as R
from tokenledger.operators import tenants as TN
from tokenledger.plans import fixtures as FX
from tokenledger.plans import oracle as O
from tokenledger.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

AS_OF = FX.AS_OF
SPLIT_TS = "2024-01-16 12:00:00"     # merge/drift tests: the key for 2024-01-16 lands on both sides
DRIFT_TS = "2024-01-29 12:00:00"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _audit(spark, sf):
    return FX.audit_from_events(read_table(spark, sf, "events"))


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# ---------------------------------------------------------------- A1, P20, T1
@register("usage_rollup", _with(O.AUDIT_CTE) + O.rollup_sql("audit"))
def q_usage_rollup(spark, sf):
    return R.usage_rollup(_audit(spark, sf))


_USAGE_COLS = ("tenant_id, \"date\", provider, total_requests, total_prompt_tokens, total_completion_tokens, "
               "total_cost_usd, cache_hits, errors")


@register("usage_range", _with(O.AUDIT_CTE, "usage AS (" + O.rollup_sql("audit") + ")") + f"""
SELECT {_USAGE_COLS} FROM usage
WHERE "date" >= DATE '{AS_OF - dt.timedelta(days=7)}' AND "date" <= DATE '{AS_OF}'
ORDER BY "date" DESC, tenant_id, provider""")
def q_usage_range(spark, sf):
    return D.usage_range(R.usage_rollup(_audit(spark, sf)), AS_OF, days=7)


@register("usage_range_tenant", _with(O.AUDIT_CTE, "usage AS (" + O.rollup_sql("audit") + ")") + f"""
SELECT {_USAGE_COLS} FROM usage
WHERE tenant_id = 'tenant_3' AND "date" >= DATE '{AS_OF - dt.timedelta(days=14)}' AND "date" <= DATE '{AS_OF}'
ORDER BY "date" DESC, provider""")
def q_usage_range_tenant(spark, sf):
    return D.usage_range(R.usage_rollup(_audit(spark, sf)), AS_OF, days=14, tenant_id="tenant_3")


# ---------------------------------------------------------------- A5, S5, J7
@register("usage_merge", _with(
    O.AUDIT_CTE,
    "a AS (" + O.rollup_sql(f"(SELECT * FROM audit WHERE created_at < TIMESTAMP '{SPLIT_TS}')") + ")",
    "b AS (" + O.rollup_sql(f"(SELECT * FROM audit WHERE created_at >= TIMESTAMP '{SPLIT_TS}')") + ")") + """
SELECT tenant_id, "date", provider,
       CAST(SUM(total_requests) AS BIGINT) AS total_requests,
       CAST(SUM(total_prompt_tokens) AS BIGINT) AS total_prompt_tokens,
       CAST(SUM(total_completion_tokens) AS BIGINT) AS total_completion_tokens,
       CAST(SUM(total_cost_usd) AS DECIMAL(22,6)) AS total_cost_usd,
       CAST(SUM(cache_hits) AS BIGINT) AS cache_hits,
       CAST(SUM(errors) AS BIGINT) AS errors
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3""")
def q_usage_merge(spark, sf):
    audit = _audit(spark, sf)
    existing = R.usage_rollup(audit.filter(F.col("created_at") < F.lit(SPLIT_TS).cast("timestamp")))
    delta = R.usage_rollup(audit.filter(F.col("created_at") >= F.lit(SPLIT_TS).cast("timestamp")))
    return R.merge_rollup(existing, delta)


# ---------------------------------------------------------------- A6
@register("rollup_drift", _with(
    O.AUDIT_CTE,
    "facts AS (" + O.rollup_sql("audit") + ")",
    "stored AS (" + O.rollup_sql(f"(SELECT * FROM audit WHERE created_at < TIMESTAMP '{DRIFT_TS}')") + ")") + """
SELECT *, 'facts' AS side FROM (SELECT * FROM facts EXCEPT ALL SELECT * FROM stored)
UNION ALL
SELECT *, 'stored' AS side FROM (SELECT * FROM stored EXCEPT ALL SELECT * FROM facts)""")
def q_rollup_drift(spark, sf):
    audit = _audit(spark, sf)
    stored = R.usage_rollup(audit.filter(F.col("created_at") < F.lit(DRIFT_TS).cast("timestamp")))
    return R.rollup_drift(audit, stored)


# ---------------------------------------------------------------- A2
def _latency_sql(where: str) -> str:
    return _with(O.AUDIT_CTE) + f"""
SELECT provider, model, CAST(AVG(latency_ms) AS DOUBLE) AS avg_latency_ms, COUNT(*) AS request_count
FROM audit WHERE latency_ms IS NOT NULL {where}
GROUP BY provider, model ORDER BY provider, model LIMIT 100"""


@register("latency_by_model", _latency_sql(""))
def q_latency_by_model(spark, sf):
    return D.latency(_audit(spark, sf))


@register("latency_tenant", _latency_sql("AND tenant_id = 'tenant_2'"))
def q_latency_tenant(spark, sf):
    return D.latency(_audit(spark, sf), tenant_id="tenant_2")


@register("latency_provider", _latency_sql("AND provider = 'anthropic'"))
def q_latency_provider(spark, sf):
    return D.latency(_audit(spark, sf), provider="anthropic")


@register("latency_tenant_provider", _latency_sql("AND tenant_id = 'tenant_2' AND provider = 'openai'"))
def q_latency_tenant_provider(spark, sf):
    return D.latency(_audit(spark, sf), tenant_id="tenant_2", provider="openai")


# ---------------------------------------------------------------- A3
def _cache_sql(where: str, days: int = 7) -> str:
    start = AS_OF - dt.timedelta(days=days)
    return _with(O.AUDIT_CTE) + f"""
SELECT cache_hits, total_requests,
       CASE WHEN total_requests = 0 THEN 0.0
            ELSE CAST(ROUND(CAST(cache_hits AS DECIMAL(20,0)) * 100 / total_requests, 2) AS DOUBLE) END AS hit_rate_pct
FROM (SELECT COUNT(*) FILTER (WHERE cache_hit) AS cache_hits, COUNT(*) AS total_requests
      FROM audit WHERE created_at >= TIMESTAMP '{start} 00:00:00' {where})"""


@register("cache_hit_rate", _cache_sql(""))
def q_cache_hit_rate(spark, sf):
    return D.cache_stats(_audit(spark, sf), AS_OF, days=7)


@register("cache_hit_rate_tenant", _cache_sql("AND tenant_id = 'tenant_4'"))
def q_cache_hit_rate_tenant(spark, sf):
    return D.cache_stats(_audit(spark, sf), AS_OF, days=7, tenant_id="tenant_4")


# ---------------------------------------------------------------- A4
def _errors_sql(where: str) -> str:
    return _with(O.AUDIT_CTE) + f"""
SELECT provider, model, COUNT(*) AS error_count
FROM audit WHERE error_message IS NOT NULL {where}
GROUP BY provider, model ORDER BY provider, model LIMIT 50"""


@register("errors_by_model", _errors_sql(""))
def q_errors_by_model(spark, sf):
    return D.errors(_audit(spark, sf))


@register("errors_tenant", _errors_sql("AND tenant_id = 'tenant_5'"))
def q_errors_tenant(spark, sf):
    return D.errors(_audit(spark, sf), tenant_id="tenant_5")


@register("errors_provider", _errors_sql("AND provider = 'anthropic'"))
def q_errors_provider(spark, sf):
    return D.errors(_audit(spark, sf), provider="anthropic")


# ---------------------------------------------------------------- P1-P5, J2, J3
@register("route_and_price", _with(f"""
base AS (
  SELECT event_id AS request_id, {O.model_case()} AS model,
         CAST(floor(value * 10) AS INTEGER) AS prompt_tokens, {O.K_EXPR} AS completion_tokens
  FROM events)""", f"""
routed AS (SELECT *, {O.provider_case('model')} AS provider FROM base)""") + f"""
SELECT request_id, provider, model, {O.fallback_case('provider', 'model')} AS fallback_model,
       {O.price_case('model', 'provider', 0)} AS price_in, {O.price_case('model', 'provider', 1)} AS price_out,
       prompt_tokens + completion_tokens AS total_tokens,
       {O.cost_expr('model', 'provider', 'prompt_tokens', 'completion_tokens')} AS cost_usd
FROM routed""")
def q_route_and_price(spark, sf):
    ev = read_table(spark, sf, "events")
    model = FX.fixture_model()
    base = ev.select(F.col("event_id").alias("request_id"), model.alias("model"),
                     F.floor(F.col("value") * 10).cast("int").alias("prompt_tokens"),
                     F.get_json_object("props", "$.k").cast("int").alias("completion_tokens"))
    routed = base.withColumn("provider", provider_of("model"))
    pin, pout = unit_prices("provider", "model")
    return routed.select(
        "request_id", "provider", "model", fallback_model("provider", "model").alias("fallback_model"),
        pin.alias("price_in"), pout.alias("price_out"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        cost_usd("provider", "model", "prompt_tokens", "completion_tokens").alias("cost_usd"))


@register("fallback_lookup", _with(f"""
m AS (SELECT {O.model_case()} AS model, COUNT(*) AS n FROM events GROUP BY 1)""") + f"""
SELECT model, {O.provider_case('model')} AS provider,
       {O.fallback_case(O.provider_case('model'), 'model')} AS fallback_model,
       CASE WHEN {O.fallback_case(O.provider_case('model'), 'model')} IS NULL THEN NULL
            ELSE {O.provider_case(O.fallback_case(O.provider_case('model'), 'model'))} END AS fallback_provider,
       n AS requests
FROM m""")
def q_fallback_lookup(spark, sf):
    """J3 in table form: requests per model joined to the fallback dimension."""
    from tokenledger.functions.routing import fallback_table
    from tokenledger.operators.dimensions import lookup_join
    m = (read_table(spark, sf, "events").groupBy(FX.fixture_model().alias("model"))
         .agg(F.count(F.lit(1)).alias("requests"))
         .withColumn("provider", provider_of("model")))
    fb = fallback_table(spark)
    out = lookup_join(m, fb, ["provider", "model"], "left")
    return out.select("model", "provider", "fallback_model",
                      F.when(F.col("fallback_model").isNotNull(), provider_of("fallback_model"))
                       .alias("fallback_provider"), "requests")


# ---------------------------------------------------------------- P17, P18, P19
_RESOLVED_SQL = """
res AS (
  SELECT request_id, any_value(tenant_id) AS tenant_id,
         arg_min(ok, attempt_no) AS a1_ok, arg_max(ok, attempt_no) AS last_ok,
         arg_min(provider, attempt_no) AS provider,
         arg_min(model, attempt_no) AS a1_model, arg_max(model, attempt_no) AS last_model,
         arg_min(prompt_tokens, attempt_no) AS a1_pt, arg_max(prompt_tokens, attempt_no) AS last_pt,
         arg_min(completion_tokens, attempt_no) AS a1_ct, arg_max(completion_tokens, attempt_no) AS last_ct,
         arg_min(error, attempt_no) AS a1_error, arg_max(error, attempt_no) AS last_error,
         COUNT(*) AS n_attempts, CAST(SUM(latency_ms) AS INTEGER) AS latency_ms
  FROM attempts GROUP BY request_id
),
outc AS (
  SELECT *, CASE WHEN a1_ok THEN 'primary'
                 WHEN n_attempts > 1 AND last_ok THEN 'fallback'
                 WHEN n_attempts > 1 THEN 'rejected_502'
                 ELSE 'error_logged' END AS outcome
  FROM res
),
resolved AS (
  SELECT request_id, tenant_id, outcome, provider,
         CASE WHEN outcome = 'fallback' THEN last_model ELSE a1_model END AS used_model,
         CAST(CASE WHEN outcome = 'primary' THEN a1_pt WHEN outcome = 'fallback' THEN last_pt ELSE 0 END AS INTEGER) AS prompt_tokens,
         CAST(CASE WHEN outcome = 'primary' THEN a1_ct WHEN outcome = 'fallback' THEN last_ct ELSE 0 END AS INTEGER) AS completion_tokens,
         latency_ms,
         CASE WHEN outcome = 'error_logged' THEN a1_error WHEN outcome = 'rejected_502' THEN last_error END AS error
  FROM outc
)"""


@register("attempt_outcomes", _with(O.ATTEMPTS_CTE, _RESOLVED_SQL) + """
SELECT request_id, tenant_id, outcome, provider, used_model, prompt_tokens, completion_tokens, latency_ms, error
FROM resolved""")
def q_attempt_outcomes(spark, sf):
    att = FX.attempts_from_events(read_table(spark, sf, "events"))
    return AT.resolve_attempts(att).drop("ts")


@register("audit_rows", _with(O.ATTEMPTS_CTE, _RESOLVED_SQL) + f"""
SELECT r.request_id, CAST(CAST(e.ts AS TIMESTAMP) AS DATE) AS event_date, r.tenant_id, r.provider,
       r.used_model AS model, r.prompt_tokens, r.completion_tokens,
       r.prompt_tokens + r.completion_tokens AS total_tokens, r.latency_ms,
       {O.cost_expr('r.used_model', O.provider_case('r.used_model'), 'r.prompt_tokens', 'r.completion_tokens')} AS cost_usd,
       FALSE AS cache_hit,
       CASE WHEN r.outcome = 'error_logged' THEN r.error END AS error_message
FROM resolved r JOIN events e ON e.event_id = r.request_id
WHERE r.outcome <> 'rejected_502'
UNION ALL
SELECT event_id, CAST(CAST(ts AS TIMESTAMP) AS DATE), {O.TENANT_EXPR}, 'cache', {O.model_case()}, 0, 0, 0,
       NULL, NULL, TRUE, NULL
FROM events WHERE event_type = 'view'""")
def q_audit_rows(spark, sf):
    ev = read_table(spark, sf, "events")
    resolved = AT.resolve_attempts(FX.attempts_from_events(ev))
    hits = (ev.filter(F.col("event_type") == "view")
            .select(F.col("event_id").alias("request_id"), "ts", FX.tenant_of("user_id").alias("tenant_id"),
                    FX.fixture_model().alias("model")))
    rows = AT.audit_rows(resolved, hits)
    return rows.select("request_id", "event_date", "tenant_id", "provider", "model", "prompt_tokens",
                       "completion_tokens", "total_tokens", "latency_ms", "cost_usd", "cache_hit", "error_message")


# ---------------------------------------------------------------- J1, P10, S3
@register("tenant_join_tools", _with(O.tenants_cte(), f"""
req AS (
  SELECT event_id AS request_id, {O.TENANT_EXPR} AS tenant_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'fn_' || CAST({O.K_EXPR} AS VARCHAR) END AS tools,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'auto' END AS tool_choice
  FROM events)""") + """
SELECT r.request_id, r.tenant_id, c.tenant_id IS NOT NULL AS cfg_present,
       COALESCE(c.rate_limit_rpm, 60) AS limit_rpm,
       CASE WHEN c.tenant_id IS NULL OR COALESCE(c.allow_tool_calls, FALSE) THEN r.tools END AS tools,
       CASE WHEN c.tenant_id IS NULL OR COALESCE(c.allow_tool_calls, FALSE) THEN r.tool_choice END AS tool_choice,
       c.system_prompt_override AS system_prompt_override,
       CASE WHEN c.tenant_id IS NOT NULL THEN '""" + ",".join(K.DEFAULT_ALLOWED_MODELS) + """' END AS allowed_models
FROM req r LEFT JOIN tenant_config c ON r.tenant_id = c.tenant_id""")
def q_tenant_join_tools(spark, sf):
    ev = read_table(spark, sf, "events")
    has_tools = F.col("event_type").isin("click", "purchase")
    req = ev.select(F.col("event_id").alias("request_id"), FX.tenant_of("user_id").alias("tenant_id"),
                    F.when(has_tools, F.concat(F.lit("fn_"), F.get_json_object("props", "$.k"))).alias("tools"),
                    F.when(has_tools, F.lit("auto")).alias("tool_choice"))
    j = TN.with_tenant_config(req, TN.conform_tenants(FX.tenant_config(spark)))
    return j.select("request_id", "tenant_id", "cfg_present", "limit_rpm",
                    TN.scope_tools(tools="tools").alias("tools"),
                    TN.scope_tools(tools="tool_choice").alias("tool_choice"),
                    "system_prompt_override",
                    F.when(F.col("cfg_present"), F.array_join("allowed_models", ",")).alias("allowed_models"))


# ---------------------------------------------------------------- S6, J6, S7
@register("seed_tenants", _with(O.tenants_cte(), f"""
seen AS (SELECT DISTINCT {O.TENANT_EXPR} AS tenant_id FROM events),
existing AS (
  SELECT c.tenant_id, c.rate_limit_rpm, c.allow_tool_calls, 5 AS n_allowed_models, 'existing' AS origin
  FROM tenant_config c JOIN seen s ON c.tenant_id = s.tenant_id),
seed AS (SELECT * FROM (VALUES ('default'), ('tenant_0'), ('tenant_9')) AS t(tenant_id))""") + """
SELECT * FROM existing
UNION ALL
SELECT s.tenant_id, 60, TRUE, 5, 'seed' FROM seed s
WHERE s.tenant_id NOT IN (SELECT tenant_id FROM existing)""")
def q_seed_tenants(spark, sf):
    seen = read_table(spark, sf, "events").select(FX.tenant_of("user_id").alias("tenant_id")).distinct()
    existing = (TN.conform_tenants(FX.tenant_config(spark).join(seen, "tenant_id", "left_semi"))
                .select("tenant_id", "rate_limit_rpm", "allow_tool_calls",
                        F.size("allowed_models").alias("n_allowed_models"), F.lit("existing").alias("origin")))
    seed = (spark.createDataFrame([("default",), ("tenant_0",), ("tenant_9",)], "tenant_id string"))
    seed = TN.conform_tenants(seed).select("tenant_id", "rate_limit_rpm", "allow_tool_calls",
                                           F.size("allowed_models").alias("n_allowed_models"),
                                           F.lit("seed").alias("origin"))
    return TN.seed_if_absent(existing, seed)


# ---------------------------------------------------------------- P7, P8
def _planted(spark, sf):
    return FX.scan_text_from_conversations(read_table(spark, sf, "conversations"))


@register("scan_turns", _with(O.planted_cte()) + f"""
SELECT conv_id, turn, {O.scan_sql('text')} AS pattern FROM st""")
def q_scan_turns(spark, sf):
    from tokenledger.operators.text_ops import scan_turns
    return scan_turns(_planted(spark, sf)).select("conv_id", "turn", "pattern")


_SCAN_CONV_SQL = _with(O.planted_cte(), f"""
sc AS (SELECT conv_id, turn, {O.scan_sql('text')} AS pattern FROM st)""") + """
SELECT conv_id, arg_min(pattern, turn) FILTER (WHERE pattern IS NOT NULL) AS pattern,
       MIN(turn) FILTER (WHERE pattern IS NOT NULL) AS first_hit_turn, COUNT(*) AS n_turns
FROM sc GROUP BY conv_id"""


@register("scan_conversations", _SCAN_CONV_SQL)
def q_scan_conversations(spark, sf):
    from tokenledger.operators.text_ops import first_hit, scan_turns
    return first_hit(scan_turns(_planted(spark, sf)), "conv_id", "turn")


@register("scan_message_arrays", _with(O.planted_cte(), f"""
sc AS (SELECT conv_id, turn, {O.scan_sql('text')} AS pattern FROM st)""") + """
SELECT conv_id, arg_min(pattern, turn) FILTER (WHERE pattern IS NOT NULL) AS pattern
FROM sc GROUP BY conv_id""")
def q_scan_message_arrays(spark, sf):
    """P8 array form: one request row per conversation, scanned in message order."""
    from tokenledger.functions.injection import scan_messages
    t = _planted(spark, sf)
    msgs = (t.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda m: F.struct(
                m["role"].alias("role"), m["text"].alias("content"),
                F.lit(None).cast("string").alias("name"))).alias("messages")))
    return msgs.select("conv_id", scan_messages("messages").alias("pattern"))


@register("scan_message_parts", _with(O.planted_cte(), f"""
sc AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN {O.scan_sql('text')} END AS pattern FROM st)""") + """
SELECT conv_id, arg_min(pattern, turn) FILTER (WHERE pattern IS NOT NULL) AS pattern
FROM sc GROUP BY conv_id""")
def q_scan_message_parts(spark, sf):
    """P8 with list contents: by turn % 3, plain text, an image and a text part, an image part only (not scanned)."""
    from tokenledger.functions.injection import scan_messages
    t = _planted(spark, sf)
    part = lambda kind, m: F.struct(F.lit(kind).alias("type"), m["text"].alias("text"))
    msgs = (t.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda m: F.struct(
                m["role"].alias("role"), F.when(m["turn"] % 3 == 0, m["text"]).alias("content"),
                F.when(m["turn"] % 3 == 1, F.array(part("image_url", m), part("text", m)))
                 .when(m["turn"] % 3 == 2, F.array(part("image_url", m))).alias("parts"))).alias("messages")))
    return msgs.select("conv_id", scan_messages("messages", with_parts=True).alias("pattern"))


# ---------------------------------------------------------------- S7
@register("column_defaults", """
SELECT 'audit' AS t, CAST(event_id AS VARCHAR) AS k, FALSE AS cache_hit, CAST(NULL AS BIGINT) AS total_requests,
       CAST(NULL AS BIGINT) AS cache_hits, CAST(value * 1000 AS BIGINT) - CASE WHEN CAST(value * 1000 AS BIGINT) > value * 1000
       THEN 1 ELSE 0 END AS latency_ms, TRUE AS dated
FROM events
UNION ALL
SELECT 'usage', 'user_' || CAST(user_id AS VARCHAR), NULL, COUNT(*), 0, NULL, NULL FROM events GROUP BY user_id""")
def q_column_defaults(spark, sf):
    """Audit and rollup rows with the columns an insert omits; milliseconds of a duration, cut toward zero."""
    from tokenledger.functions.timeutil import millis
    ev = read_table(spark, sf, "events")
    audit = TN.conform(ev.select(F.col("event_id").cast("string").alias("k"), millis("value").alias("latency_ms")), TN.AUDIT_DEFAULTS)
    usage = TN.conform(ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_requests")), TN.USAGE_DEFAULTS)
    none = F.lit(None)
    return (audit.select(F.lit("audit").alias("t"), "k", "cache_hit", none.cast("bigint").alias("total_requests"),
                         none.cast("bigint").alias("cache_hits"), "latency_ms", F.col("created_at").isNotNull().alias("dated"))
            .unionByName(usage.select(
                F.lit("usage").alias("t"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("k"),
                none.cast("boolean").alias("cache_hit"), "total_requests", "cache_hits",
                none.cast("bigint").alias("latency_ms"), none.cast("boolean").alias("dated"))))


# ---------------------------------------------------------------- P6
@register("prompt_text", """
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt_text FROM conversations GROUP BY conv_id""")
def q_prompt_text(spark, sf):
    from tokenledger.operators.text_ops import ordered_string_agg
    return ordered_string_agg(read_table(spark, sf, "conversations"), "conv_id", "turn", "text", "\n",
                              out_col="prompt_text")


# ---------------------------------------------------------------- P11, P12
def _messages(spark, sf):
    return FX.messages_from_conversations(read_table(spark, sf, "conversations"), FX.tenant_config(spark))


@register("prompt_isolation", _with(O.tenants_cte(), O.message_turns_cte(), f"""
iso AS (SELECT conv_id, tenant_id, {O.isolate_sql('messages', 'ov')} AS m FROM msgs)""") + """
SELECT conv_id, tenant_id, len(m) AS n_messages, m[1].role AS first_role, m[1].content AS first_content,
       len(list_filter(m, lambda x: x.role = 'system')) AS n_system,
       array_to_string(list_transform(m, lambda x: x.content), chr(10)) AS prompt_text
FROM iso""")
def q_prompt_isolation(spark, sf):
    from tokenledger.functions.messages import isolate_system_prompt, prompt_text
    m = _messages(spark, sf).withColumn("m", isolate_system_prompt("messages", "system_prompt_override"))
    return m.select("conv_id", "tenant_id", F.size("m").cast("bigint").alias("n_messages"),
                    F.get("m", 0)["role"].alias("first_role"), F.get("m", 0)["content"].alias("first_content"),
                    F.size(F.filter("m", lambda x: x["role"] == "system")).cast("bigint").alias("n_system"),
                    prompt_text("m").alias("prompt_text"))


@register("message_split", _with(O.tenants_cte(), O.message_turns_cte(), """
norm AS (SELECT conv_id, list_transform(messages, lambda x: {'role': COALESCE(x.role, 'user'),
                                                        'content': COALESCE(x.content, '')}) AS m FROM msgs)""") + """
SELECT conv_id,
       COALESCE(list_filter(m, lambda x: x.role = 'system')[-1].content, '') AS system_text,
       len(list_filter(m, lambda x: x.role <> 'system')) AS n_turns,
       array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'),
                                      lambda x: x.role || ':' || x.content), '|') AS turns_text
FROM norm""")
def q_message_split(spark, sf):
    from tokenledger.functions.messages import split_system
    m = _messages(spark, sf)
    system_text, turns = split_system("messages")
    return m.select("conv_id", system_text.alias("system_text"), F.size(turns).cast("bigint").alias("n_turns"),
                    F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
                     .alias("turns_text"))


# ---------------------------------------------------------------- P9
@register("sanitize_log", f"""
SELECT doc_id,
       CASE WHEN text IS NULL OR text = '' THEN ''
            ELSE replace(substring({O.strip_sql('text')}, 1, 500), chr(10), ' ') END AS sanitized
FROM documents""")
def q_sanitize_log(spark, sf):
    from tokenledger.functions.text import sanitize_for_log
    return read_table(spark, sf, "documents").select("doc_id", sanitize_for_log("text").alias("sanitized"))


# ---------------------------------------------------------------- S1, S2
@register("request_ingest", f"""
SELECT conv_id AS request_id,
       CASE conv_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN '' ELSE 'tenant_' || CAST(conv_id % 10 AS VARCHAR) END
         AS tenant_id,
       CASE WHEN conv_id % 4 <> 0 AND conv_id % 23 <> 9 THEN {O.model_case('conv_id')} ELSE 'gpt-4' END AS model,
       CASE WHEN conv_id % 23 = 9 THEN FALSE WHEN conv_id % 2 <> 0 THEN conv_id % 6 = 1 ELSE conv_id % 23 = 4 END AS stream,
       CASE WHEN conv_id % 23 = 9 THEN NULL WHEN conv_id % 3 = 0 THEN CAST(conv_id % 10 AS DOUBLE) / 10 WHEN conv_id % 23 = 5 THEN 0.5 END AS temperature,
       CAST(CASE WHEN conv_id % 23 = 9 THEN NULL WHEN conv_id % 3 = 1 THEN conv_id % 5 * 100 WHEN conv_id % 23 = 2 THEN 700
                 WHEN conv_id % 23 = 6 THEN 5 END AS BIGINT) AS max_tokens,
       COUNT(*) AS n_messages,
       conv_id % 17 <> 16 AND conv_id % 23 NOT IN (1, 3, 9) AND NOT (conv_id % 23 = 8 AND conv_id % 4 = 0)
         AND NOT (conv_id % 23 = 7 AND bool_or(role = 'user')) AS valid,
       CASE WHEN conv_id % 23 = 9 THEN '' ELSE string_agg(text, chr(10) ORDER BY turn) END AS prompt_text
FROM conversations GROUP BY conv_id""")
def q_request_ingest(spark, sf):
    from tokenledger.functions.messages import prompt_text
    from tokenledger.sources.requests import ingest_requests
    raw = FX.request_json_from_conversations(read_table(spark, sf, "conversations"))
    r = ingest_requests(raw, keep=("request_id",))
    return r.select("request_id", "tenant_id", "model", "stream", "temperature", "max_tokens",
                    F.size("messages").cast("bigint").alias("n_messages"), "valid",
                    prompt_text("messages").alias("prompt_text"))


@register("request_files", f"""
SELECT conv_id AS request_id,
       CASE conv_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN '' ELSE 'tenant_' || CAST(conv_id % 10 AS VARCHAR) END
         AS tenant_id,
       COUNT(*) AS n_messages,
       conv_id % 17 <> 16 AND conv_id % 23 NOT IN (1, 3, 9) AND NOT (conv_id % 23 = 8 AND conv_id % 4 = 0)
         AND NOT (conv_id % 23 = 7 AND bool_or(role = 'user')) AS valid
FROM conversations GROUP BY conv_id""")
def q_request_files(spark, sf):
    """S1 as a source: JSON request files read as a stream, sorted into the accepted and the quarantine in one pass."""
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources.requests import read_requests, stream_request_files, stream_requests_sink
    from tokenledger.streaming.jobs import run_available
    base = scratch_path(spark, f"request_files/{uuid.uuid4().hex}")
    raw = FX.request_json_from_conversations(read_table(spark, sf, "conversations"))
    raw.select("request_id", F.lit("2024-01-01 00:00:00").alias("ts"), "headers", "body").write.json(f"{base}/in")
    lines = stream_request_files(spark, f"{base}/in/*.json", "request_id long, ts timestamp, headers map<string,string>, body string")
    run_available(stream_requests_sink(lines, f"{base}/out", f"{base}/_checkpoint"))
    ok, quarantine = read_requests(spark, f"{base}/out")
    cols = ["request_id", "tenant_id", F.size("messages").cast("bigint").alias("n_messages")]
    return (ok.select(*cols, F.lit(True).alias("valid"))
            .unionByName(quarantine.select(*cols, F.lit(False).alias("valid"))))


# ---------------------------------------------------------------- W1, W2, W3, P16
RL_WINDOW_S = 3600          # FIXTURES §2.3: W=3600 s with ten tenants at sf0.01
TTL_S = 7200


def _rl_requests(spark, sf):
    req = FX.requests_from_events(read_table(spark, sf, "events")).drop("stream")
    return TN.with_tenant_config(req, FX.tenant_config(spark)).select("request_id", "ts", "tenant_id", "limit_rpm")


_RL_REQ_SQL = f"req AS (SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, {O.TENANT_EXPR} AS tenant_id FROM events)"


@register("rate_limit", "WITH RECURSIVE " + ",\n".join(
    [O.tenants_cte(), _RL_REQ_SQL, O.limited_requests_cte("req").strip(), O.anchored_cte("seq", RL_WINDOW_S).strip()])
    + """
SELECT j.request_id, j.tenant_id, j.limit_rpm, COALESCE(rl.n, 0) AS window_count,
       rl.anchor AS window_start_us, (j.limit_rpm <= 0 OR rl.n <= j.limit_rpm) AS allowed
FROM jr j LEFT JOIN rl ON rl.request_id = j.request_id""")
def q_rate_limit(spark, sf):
    from tokenledger.operators.admission import rate_limit
    r = rate_limit(_rl_requests(spark, sf), window_s=RL_WINDOW_S)
    return r.select("request_id", "tenant_id", "limit_rpm", "window_count",
                    F.unix_micros("window_start").alias("window_start_us"), "allowed")


@register("rate_remaining", "WITH RECURSIVE " + ",\n".join(
    [O.tenants_cte(), _RL_REQ_SQL, O.limited_requests_cte("req").strip(), O.anchored_cte("seq", RL_WINDOW_S).strip()])
    + f""",
state AS (SELECT rl.tenant_id, s.t, rl.anchor, rl.n FROM rl JOIN seq s ON s.request_id = rl.request_id),
probes AS (SELECT tenant_id, epoch_us(ts + INTERVAL 20 MINUTE) AS t_us, limit_rpm FROM jr),
joined AS (
  SELECT p.tenant_id, p.t_us, p.limit_rpm,
         CASE WHEN st.t IS NOT NULL AND p.t_us < st.anchor + {RL_WINDOW_S}::BIGINT * 1000000 THEN st.n ELSE 0 END
           AS live_count
  FROM probes p ASOF LEFT JOIN state st ON p.tenant_id = st.tenant_id AND p.t_us >= st.t
)
SELECT tenant_id, t_us, limit_rpm, CAST(live_count AS BIGINT) AS live_count,
       CAST(CASE WHEN limit_rpm <= 0 THEN 0 ELSE greatest(0, limit_rpm - live_count) END AS BIGINT) AS remaining
FROM joined""")
def q_rate_remaining(spark, sf):
    """W2 as-of: quota left 20 minutes after each request, per tenant."""
    from tokenledger.operators.admission import rate_limit, remaining_as_of
    req = _rl_requests(spark, sf)
    counted = rate_limit(req, window_s=RL_WINDOW_S).filter(F.col("limit_rpm") > 0)
    probes = req.select("tenant_id", (F.col("ts") + F.expr("INTERVAL 20 MINUTES")).alias("t"), "limit_rpm")
    out = remaining_as_of(counted, probes, RL_WINDOW_S)
    return out.select("tenant_id", F.unix_micros("t").alias("t_us"), "limit_rpm", "live_count", "remaining")


@register("ttl_counter", f"""
WITH e AS (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events),
g AS (
  SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {TTL_S}::BIGINT * 1000000 THEN 1 ELSE 0 END AS brk
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, sid ORDER BY t, event_id) AS counter,
       MIN(t) OVER (PARTITION BY user_id, sid) AS session_start_us
FROM s""")
def q_ttl_counter(spark, sf):
    from tokenledger.operators.admission import ttl_counter
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = ttl_counter(ev, "user_id", ttl_s=TTL_S)
    return out.select("event_id", "user_id", "counter", F.unix_micros("session_start").alias("session_start_us"))


@register("ttl_counter_forever", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter FROM events""")
def q_ttl_counter_forever(spark, sf):
    from tokenledger.operators.admission import ttl_counter
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ttl_counter(ev, "user_id", ttl_s=None).select("event_id", "user_id", "counter")


def _admission_base(spark, sf):
    """Request rows (request_id, ts, tenant_id, stream, messages) built from the
    planted conversations."""
    t = _planted(spark, sf)
    msgs = (t.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
            .select(F.col("conv_id").alias("request_id"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp")
                     + F.make_dt_interval(mins=F.col("conv_id").cast("int"))).alias("ts"),
                    F.concat(F.lit("tenant_"), (F.col("conv_id") % 10).cast("string")).alias("tenant_id"),
                    (F.col("conv_id") % 11 == 0).alias("stream"),
                    F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"),
                                                         F.lit(None).cast("string").alias("name"))).alias("messages")))
    return msgs


def _admission_requests(spark, sf):
    from tokenledger.functions.injection import scan_messages
    msgs = _admission_base(spark, sf).withColumn("scan_hit", scan_messages("messages"))
    return TN.with_tenant_config(msgs, FX.tenant_config(spark))


@register("admission", "WITH RECURSIVE " + ",\n".join([
    O.tenants_cte(), O.planted_cte().strip(),
    f"sc AS (SELECT conv_id, turn, {O.scan_sql('text')} AS pattern FROM st)",
    """areq AS (
  SELECT conv_id AS request_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id AS BIGINT)) AS ts,
         'tenant_' || CAST(conv_id % 10 AS VARCHAR) AS tenant_id, conv_id % 11 = 0 AS stream,
         arg_min(pattern, turn) FILTER (WHERE pattern IS NOT NULL) AS scan_hit
  FROM sc GROUP BY conv_id)""",
    "nonstream AS (SELECT * FROM areq WHERE NOT stream)",
    O.limited_requests_cte("nonstream").strip(),
    O.anchored_cte("seq", RL_WINDOW_S).strip()]) + """
SELECT a.request_id, a.tenant_id,
       CASE WHEN a.stream THEN 501
            WHEN j.limit_rpm > 0 AND rl.n > j.limit_rpm THEN 429
            WHEN a.scan_hit IS NOT NULL THEN 400 ELSE 200 END AS status,
       CASE WHEN a.stream THEN 'streaming not supported'
            WHEN j.limit_rpm > 0 AND rl.n > j.limit_rpm THEN 'rate limit exceeded'
            WHEN a.scan_hit IS NOT NULL THEN 'injection: ' || a.scan_hit END AS reason,
       CASE WHEN a.stream THEN NULL ELSE COALESCE(rl.n, 0) END AS window_count
FROM areq a LEFT JOIN jr j ON j.request_id = a.request_id LEFT JOIN rl ON rl.request_id = a.request_id""")
def q_admission(spark, sf):
    from tokenledger.operators.admission import admit
    out = admit(_admission_requests(spark, sf), window_s=RL_WINDOW_S)
    return out.select("request_id", "tenant_id", "status", "reason", "window_count")


# ---------------------------------------------------------------- V1-V4, J4, J5, W4-W6
def _emb(spark, sf):
    return read_table(spark, sf, "embeddings")


@register("cosine_pairs", _with(O.EMB_CTE) + f"""
SELECT query_id, ROUND({O.sim_sql('q', 'self_vec')}, 6) AS sim_self,
       ROUND({O.sim_sql('q', 'next_vec')}, 6) AS sim_next
FROM qv""")
def q_cosine_pairs(spark, sf):
    from tokenledger.functions.vectors import cosine
    q = FX.queries_from_embeddings(_emb(spark, sf))
    return q.select("query_id", F.round(cosine("embedding", "self_vec"), 6).alias("sim_self"),
                    F.round(cosine("embedding", "next_vec"), 6).alias("sim_next"))


@register("index_retention", _with(O.EMB_CTE) + """
SELECT response_id, seq FROM idx""")
def q_index_retention(spark, sf):
    from tokenledger.operators.similarity import retained_index
    emb = _emb(spark, sf)
    return retained_index(FX.index_from_embeddings(emb), FX.index_as_of(emb)).select("response_id", "seq")


_MATCH_SQL = f""",
qn AS MATERIALIZED (SELECT query_id, q, {O.norm_sql('q')} AS nq FROM qv),
xn AS MATERIALIZED (SELECT response_id, seq, v, {O.norm_sql('v')} AS nv FROM idx),
pairs AS MATERIALIZED (
  SELECT * FROM (SELECT query_id, response_id, seq, list_dot_product(q, v) / (nq * nv + 1e-9) AS sim FROM qn, xn)
  WHERE sim >= 0.95),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, seq) AS rk FROM pairs),
best AS (
  SELECT qn.query_id, r.response_id, r.seq, r.sim
  FROM qn LEFT JOIN ranked r ON r.query_id = qn.query_id AND r.rk = 1)"""


@register("semantic_match", _with(O.EMB_CTE) + _MATCH_SQL + """
SELECT query_id, response_id, seq, ROUND(sim, 6) AS sim FROM best""")
def q_semantic_match(spark, sf):
    from tokenledger.operators.similarity import best_match, retained_index
    emb = _emb(spark, sf)
    idx = retained_index(FX.index_from_embeddings(emb), FX.index_as_of(emb))
    m = best_match(FX.queries_from_embeddings(emb), idx)
    return m.select("query_id", "response_id", "seq", F.round("sim", 6).alias("sim"))


@register("semantic_lookup", _with(O.EMB_CTE) + _MATCH_SQL + """,
alive AS (
  SELECT i.response_id, to_json({'id': i.response_id, 'object': 'chat.completion'}) AS value
  FROM idx_all i, asof_t a
  WHERE i.inserted_at <= a.as_of AND a.as_of < i.inserted_at + INTERVAL 1 HOUR)
SELECT b.query_id, b.response_id, al.response_id IS NOT NULL AS hit,
       CASE WHEN al.response_id IS NOT NULL THEN b.response_id END AS served_id
FROM best b LEFT JOIN alive al ON al.response_id = b.response_id""")
def q_semantic_lookup(spark, sf):
    """V2 + J5 + W6: a match whose response expired is a miss."""
    from tokenledger.operators.similarity import best_match, lookup_responses, retained_index
    emb = _emb(spark, sf)
    as_of = FX.index_as_of(emb)
    idx = retained_index(FX.index_from_embeddings(emb), as_of)
    m = best_match(FX.queries_from_embeddings(emb), idx)
    out = lookup_responses(m, FX.responses_from_embeddings(emb), as_of)
    return out.select("query_id", "response_id", "hit",
                      F.when(F.col("hit"), F.get_json_object("response", "$.id")).alias("served_id"))


# V2 with per-tenant isolation: entries belong to tenant vec_id % 3; a quarter of
# the prompts (vec_id % 4 = 3) are asked by the tenant of the next vector, so
# their global best match lies in another tenant's index and must not be seen.
_TENANT_SQL = """
tidx_all AS (SELECT *, 'tenant_' || CAST(seq % 3 AS VARCHAR) AS tenant_id FROM idx_all),
tsess AS (
  SELECT *, CASE WHEN lag(inserted_at) OVER w IS NULL OR inserted_at - lag(inserted_at) OVER w >= INTERVAL 7 DAY
                 THEN 1 ELSE 0 END AS brk
  FROM tidx_all WHERE inserted_at <= (SELECT as_of FROM asof_t)
  WINDOW w AS (PARTITION BY tenant_id ORDER BY inserted_at, seq)),
tb AS (SELECT tenant_id, MAX((inserted_at, seq)) FILTER (WHERE brk = 1) AS st, MAX(inserted_at) AS last
       FROM tsess GROUP BY tenant_id),
tcur AS (
  SELECT s.* FROM tsess s JOIN tb ON s.tenant_id = tb.tenant_id
  WHERE (s.inserted_at, s.seq) >= tb.st AND (SELECT as_of FROM asof_t) < tb.last + INTERVAL 7 DAY),
tidx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq DESC) AS rn FROM tcur)
         WHERE rn <= 500),
tq AS MATERIALIZED (SELECT query_id, q, """ + O.norm_sql('q') + """ AS nq,
              'tenant_' || CAST((query_id + CASE WHEN query_id % 4 = 3 THEN 1 ELSE 0 END) % 3 AS VARCHAR) AS tenant_id
       FROM qv),
tn AS MATERIALIZED (SELECT tenant_id, response_id, seq, v, """ + O.norm_sql('v') + """ AS nv FROM tidx),
tpairs AS MATERIALIZED (
  SELECT * FROM (SELECT tq.query_id, tn.response_id, tn.seq, list_dot_product(q, v) / (nq * nv + 1e-9) AS sim
                 FROM tq JOIN tn ON tn.tenant_id = tq.tenant_id)
  WHERE sim >= 0.95),
tranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, seq) AS rk FROM tpairs)"""


@register("semantic_match_tenant", _with(O.EMB_CTE) + ",\n" + _TENANT_SQL.strip() + """
SELECT tq.tenant_id, tq.query_id, r.response_id, r.seq, ROUND(r.sim, 6) AS sim
FROM tq LEFT JOIN tranked r ON r.query_id = tq.query_id AND r.rk = 1""")
def q_semantic_match_tenant(spark, sf):
    """V2 + W4/W5 per tenant (``partition_cols``): each tenant keeps and
    searches only its own index."""
    from tokenledger.operators.similarity import best_match, retained_index
    emb = _emb(spark, sf)
    idx = FX.index_from_embeddings(emb).withColumn(
        "tenant_id", F.concat(F.lit("tenant_"), (F.col("seq") % 3).cast("string")))
    kept = retained_index(idx, FX.index_as_of(emb), partition_cols=["tenant_id"])
    qid = F.col("query_id")
    q = FX.queries_from_embeddings(emb).withColumn(
        "tenant_id", F.concat(F.lit("tenant_"),
                              ((qid + F.when(qid % 4 == 3, 1).otherwise(0)) % 3).cast("string")))
    m = best_match(q, kept, partition_cols=["tenant_id"])
    return m.select("tenant_id", "query_id", "response_id", "seq", F.round("sim", 6).alias("sim"))


@register("saved_calls", _with(O.EMB_CTE) + """,
reqs AS MATERIALIZED (
  SELECT *, epoch_us(ts) AS t, epoch_us(ts) // 3600000000 AS hour, """ + O.norm_sql('v') + """ AS n FROM (
    SELECT query_id AS request_id, ts, q AS v FROM qv
    UNION ALL
    SELECT vec_id + 1000000000, TIMESTAMP '2024-01-01 00:00:30' + to_minutes(CAST(vec_id AS BIGINT)), v FROM emb)),
earlier AS (SELECT *, hour + unnest([0, 1]) AS meets FROM reqs),
pairs AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.request_id, b.request_id AS match_id, b.t AS mts, list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) AS sim
    FROM reqs a JOIN earlier b ON b.meets = a.hour
    WHERE (b.t < a.t OR (b.t = a.t AND b.request_id < a.request_id)) AND a.t - b.t <= 3600000000)
  WHERE sim >= 0.95),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, mts, match_id) AS rk FROM pairs)
SELECT r.request_id, k.match_id, ROUND(k.sim, 6) AS match_sim
FROM reqs r LEFT JOIN ranked k ON k.request_id = r.request_id AND k.rk = 1""")
def q_saved_calls(spark, sf):
    """V4: calls a cache could have served from a request of the previous hour.
    Requests: the prompts plus a repeat of every stored vector 30 s after it."""
    from tokenledger.operators.similarity import similar_earlier
    emb = _emb(spark, sf)
    q = FX.queries_from_embeddings(emb).select(F.col("query_id").alias("request_id"), "ts", "embedding")
    rep = emb.select((F.col("vec_id") + 1_000_000_000).alias("request_id"),
                     (F.lit("2024-01-01 00:00:30").cast("timestamp")
                      + F.make_dt_interval(mins=F.col("vec_id").cast("int"))).alias("ts"),
                     F.col("embedding").cast("array<double>").alias("embedding"))
    out = similar_earlier(q.unionByName(rep))
    return out.select("request_id", "match_id", F.round("match_sim", 6).alias("match_sim"))


# ---------------------------------------------------------------- P13, P14, P15, P21
_TURN_EV_SQL = f"""
te AS (
  SELECT c.conv_id, c.turn, c.role, c.text, e.event_id AS request_id,
         CAST(floor(e.value * 10) AS BIGINT) AS ptok, CAST({O.K_EXPR} AS BIGINT) AS ctok
  FROM conversations c LEFT JOIN events e ON e.event_id = c.conv_id * 8 + c.turn)"""


@register("normalize_responses", _with(_TURN_EV_SQL) + """
SELECT request_id, 'msg_' || CAST(request_id AS VARCHAR) AS id, 'claude-3-haiku-20240307' AS model,
       CASE (conv_id + turn) % 5 WHEN 2 THEN '' WHEN 3 THEN text || '[' || role || ']' ELSE text END AS content,
       CASE WHEN (conv_id + turn) % 5 = 1 THEN 0 ELSE ptok END AS prompt_tokens,
       CASE WHEN (conv_id + turn) % 5 = 1 THEN 0 ELSE ctok END AS completion_tokens,
       CASE WHEN (conv_id + turn) % 5 = 1 THEN 0 ELSE ptok + ctok END AS total_tokens,
       'stop' AS finish_reason, CAST(0 AS BIGINT) AS created
FROM te""")
def q_normalize_responses(spark, sf):
    from tokenledger.functions.responses import normalize_b
    r = FX.responses_b(read_table(spark, sf, "conversations"), read_table(spark, sf, "events"))
    n = r.select("request_id", normalize_b("response").alias("n"))
    return n.select("request_id", "n.id", "n.model", F.col("n.choices")[0]["message"]["content"].alias("content"),
                    "n.usage.prompt_tokens", "n.usage.completion_tokens", "n.usage.total_tokens",
                    F.col("n.choices")[0]["finish_reason"].alias("finish_reason"), "n.created")


@register("native_usage", _with(_TURN_EV_SQL) + """
SELECT request_id,
       CASE WHEN (conv_id + turn) % 4 = 2 THEN '' ELSE 'chatcmpl_' || CAST(request_id AS VARCHAR) END AS id,
       CASE (conv_id + turn) % 4 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n_choices,
       CASE WHEN (conv_id + turn) % 4 IN (1, 2) THEN 0 ELSE ptok END AS prompt_tokens,
       CASE WHEN (conv_id + turn) % 4 IN (1, 2) THEN 0 ELSE ctok END AS completion_tokens,
       'chat.completion' AS object, '' AS model,
       CASE (conv_id + turn) % 4 WHEN 2 THEN NULL WHEN 3 THEN text || '|' || text ELSE text END AS contents,
       CASE WHEN (conv_id + turn) % 4 NOT IN (1, 2) THEN ptok + ctok END AS total_tokens
FROM te""")
def q_native_usage(spark, sf):
    from tokenledger.functions.responses import native_usage
    r = FX.responses_a(read_table(spark, sf, "conversations"), read_table(spark, sf, "events"))
    u = r.select("request_id", native_usage("response").alias("u"))
    return u.select("request_id", "u.id", "u.n_choices", "u.prompt_tokens", "u.completion_tokens", "u.object", "u.model",
                    F.when(F.size("u.choices") > 0, F.array_join(F.transform("u.choices", lambda c: c["message"]["content"]), "|"))
                     .alias("contents"), "u.usage.total_tokens")


@register("payload_shape", _with(O.tenants_cte(), O.message_turns_cte(), f"""
p AS (
  SELECT conv_id, messages, {O.model_case('conv_id')} AS model,
         CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 10 AS DOUBLE) / 10 END AS temperature,
         CASE WHEN conv_id % 3 = 1 THEN CAST(conv_id % 5 * 100 AS INTEGER) END AS max_tokens
  FROM msgs)""") + f"""
SELECT conv_id AS request_id, {O.provider_case('model')} AS provider,
       CASE WHEN {O.provider_case('model')} = 'anthropic'
            THEN CASE WHEN max_tokens IS NULL OR max_tokens = 0 THEN 1024 ELSE max_tokens END
            ELSE max_tokens END AS max_tokens_sent,
       temperature IS NOT NULL AS has_temperature,
       CASE WHEN {O.provider_case('model')} = 'anthropic'
            THEN COALESCE(list_filter(messages, lambda x: COALESCE(x.role, 'user') = 'system')[-1].content, '')
       END AS system_sent,
       CASE WHEN {O.provider_case('model')} = 'anthropic'
            THEN len(list_filter(messages, lambda x: COALESCE(x.role, 'user') <> 'system'))
            ELSE len(messages) END AS n_messages_sent
FROM p""")
def q_payload_shape(spark, sf):
    """P13 (+P12): the outbound payload per provider, checked field by field."""
    from tokenledger.functions.messages import split_system
    from tokenledger.functions.routing import payload_a, payload_b
    m = _messages(spark, sf)
    cid = F.col("conv_id")
    m = m.select("conv_id", "messages",
                 F.element_at(F.array(*[F.lit(x) for x in FX.FIXTURE_MODELS]), (cid % 7 + 1).cast("int")).alias("model"),
                 F.when(cid % 3 == 0, (cid % 10).cast("double") / 10).alias("temperature"),
                 F.when(cid % 3 == 1, (cid % 5 * 100).cast("int")).alias("max_tokens"))
    system, turns = split_system("messages")
    prov = provider_of("model")
    payload = F.when(prov == "anthropic", payload_b("model", system, turns, "temperature", "max_tokens")) \
               .otherwise(payload_a("model", "messages", "temperature", "max_tokens"))
    p = m.select("conv_id", prov.alias("provider"), payload.alias("payload"))
    return p.select(F.col("conv_id").alias("request_id"), "provider",
                    F.get_json_object("payload", "$.max_tokens").cast("int").alias("max_tokens_sent"),
                    F.get_json_object("payload", "$.temperature").isNotNull().alias("has_temperature"),
                    F.get_json_object("payload", "$.system").alias("system_sent"),
                    F.json_array_length(F.get_json_object("payload", "$.messages")).cast("bigint")
                     .alias("n_messages_sent"))


@register("cacheable_responses", _with(O.ATTEMPTS_CTE, _RESOLVED_SQL, """
pt AS (
  SELECT conv_id, CASE WHEN conv_id % 9 = 0 THEN '' ELSE string_agg(text, chr(10) ORDER BY turn) END AS prompt_text
  FROM conversations GROUP BY conv_id)""") + """
SELECT r.request_id, r.outcome,
       COALESCE(r.outcome IN ('primary', 'fallback') AND length(p.prompt_text) > 0, FALSE) AS cacheable,
       COALESCE(r.outcome IN ('primary', 'fallback', 'error_logged') AND length(p.prompt_text) > 0, FALSE)
         AS cacheable_with_errors
FROM resolved r LEFT JOIN pt p ON p.conv_id = r.request_id""")
def q_cacheable_responses(spark, sf):
    """Which responses would be stored in the cache (D7 both ways)."""
    from tokenledger.operators.text_ops import ordered_string_agg
    resolved = AT.resolve_attempts(FX.attempts_from_events(read_table(spark, sf, "events")))
    pt = ordered_string_agg(read_table(spark, sf, "conversations"), "conv_id", "turn", "text", "\n", "prompt_text")
    pt = pt.withColumn("prompt_text", F.when(F.col("conv_id") % 9 == 0, F.lit("")).otherwise(F.col("prompt_text")))
    j = resolved.join(pt.withColumnRenamed("conv_id", "request_id"), "request_id", "left")
    return j.select("request_id", "outcome", AT.cacheable_flag().alias("cacheable"),
                    AT.cacheable_flag(include_errors=True).alias("cacheable_with_errors"))


# ---------------------------------------------------------------- S8, S9
KV_AS_OF = "2024-01-30 12:00:00"


@register("kv_latest_live", f"""
WITH w AS (
  SELECT 'k' || CAST(user_id % 20 AS VARCHAR) AS key,
         CASE WHEN event_type = 'error' THEN 'upstream timeout ' || CAST(event_id AS VARCHAR) ELSE props END AS value,
         CAST(ts AS TIMESTAMP) AS written_at,
         CASE WHEN event_type = 'click' THEN 600 ELSE 3600 END AS ttl_seconds, event_id
  FROM events WHERE CAST(ts AS TIMESTAMP) <= TIMESTAMP '{KV_AS_OF}'),
l AS (SELECT key, arg_max(value, (written_at, event_id)) AS value, arg_max(ttl_seconds, (written_at, event_id)) AS ttl,
             MAX(written_at) AS written_at FROM w GROUP BY key)
SELECT key, CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.k') AS INTEGER) END AS k,
       CASE WHEN json_valid(value) THEN NULL ELSE value END AS raw, epoch_us(written_at) AS written_us
FROM l WHERE TIMESTAMP '{KV_AS_OF}' < written_at + to_seconds(CAST(ttl AS BIGINT))""")
def q_kv_latest_live(spark, sf):
    """S9 writes derived from events, S8 read at a fixed instant."""
    from tokenledger.sources.kv import kv_latest_live, kv_write
    store = kv_write(None, FX.kv_writes_from_events(read_table(spark, sf, "events")))
    out = kv_latest_live(store, KV_AS_OF)
    return out.select("key", F.try_variant_get("json", "$.k", "int").alias("k"), "raw",
                      F.unix_micros("written_at").alias("written_us"))


@register("kv_store", ORACLE["kv_latest_live"])
def q_kv_store(spark, sf):
    """S9 in batches to the log, compacted on the way, S8 from the snapshot and the log behind it."""
    import uuid
    from tokenledger.functions.timeutil import ts_lit
    from tokenledger.session import scratch_path
    from tokenledger.sources.kv import kv_append, kv_compact, kv_latest_live, kv_table
    path = scratch_path(spark, f"kv_store/{uuid.uuid4().hex}")
    writes = FX.kv_writes_from_events(read_table(spark, sf, "events"))
    # four batches in the order of time, cut three, two and one hours before the read
    cuts = [ts_lit(KV_AS_OF) - F.make_dt_interval(hours=F.lit(h)) for h in (3, 2, 1)]
    batch = sum(F.when(F.col("written_at") > c, 1).otherwise(0) for c in cuts)
    for b in range(4):
        kv_append(spark, path, writes.filter(batch == b), b)
        if b == 2:
            kv_compact(spark, path, cuts[-1], b)
    out = kv_latest_live(kv_table(spark, path), KV_AS_OF)
    return out.select("key", F.try_variant_get("json", "$.k", "int").alias("k"), "raw",
                      F.unix_micros("written_at").alias("written_us"))


# ---------------------------------------------------------------- ST1-ST5, S4, S5
def _staged_events(spark, sf, name):
    """Events split into four time-ordered files (derived, under the checkpoint
    folder) and read back as a file stream, one file per micro-batch."""
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.streaming.jobs import file_stream, stage_time_ordered
    ev = read_table(spark, sf, "events")
    glob = stage_time_ordered(ev, "ts", scratch_path(spark, f"staged/{name}/{uuid.uuid4().hex}"), tie="event_id")
    return file_stream(spark, glob, ev.schema)


@register("stream_usage", _with(O.AUDIT_CTE) + O.rollup_sql("audit"))
def q_stream_usage(spark, sf):
    """ST3 + S5: streaming rollup upserted per micro-batch = batch rollup."""
    from tokenledger.streaming.jobs import run_usage_upserts
    audit = FX.audit_from_events(_staged_events(spark, sf, "stream_usage"))
    return run_usage_upserts(audit, spark, "stream_usage").select(*R.KEYS, *R.COUNTERS)


@register("stream_audit_append", _with(O.AUDIT_CTE) + """
SELECT request_id, CAST(created_at AS DATE) AS event_date, tenant_id, provider, model, prompt_tokens,
       completion_tokens, total_tokens, latency_ms, cost_usd, cache_hit, error_message
FROM audit""")
def q_stream_audit_append(spark, sf):
    """ST2 + S4: audit stream appended to a Parquet table partitioned by
    event_date (file sink, exactly-once through its checkpoint)."""
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.sources.sinks import audit_stream_sink
    from tokenledger.streaming.jobs import run_available
    audit = FX.audit_from_events(_staged_events(spark, sf, "stream_audit"))
    base = scratch_path(spark, f"streams/stream_audit_append/{uuid.uuid4().hex}")
    run_available(audit_stream_sink(audit, f"{base}/audit", f"{base}/_checkpoint"))
    out = spark.read.parquet(f"{base}/audit")          # partitioned by event_date
    return out.select("request_id", "event_date", "tenant_id", "provider", "model", "prompt_tokens",
                      "completion_tokens", "total_tokens", "latency_ms", "cost_usd", "cache_hit", "error_message")


@register("stream_rate_limit", ORACLE["rate_limit"])
def q_stream_rate_limit(spark, sf):
    """ST1 + ST4: W1 as keyed streaming state = the batch rate_limit."""
    from tokenledger.streaming.jobs import run_to_parquet, stream_rate_limit
    ev = _staged_events(spark, sf, "stream_rl")
    req = FX.requests_from_events(ev).drop("stream")
    s = stream_rate_limit(req, FX.tenant_config(spark), window_s=RL_WINDOW_S)
    out = run_to_parquet(s, spark, "stream_rate_limit")
    return out.select("request_id", "tenant_id", "limit_rpm", "window_count",
                      F.unix_micros("window_start").alias("window_start_us"), "allowed")


@register("stream_admission", ORACLE["admission"])
def q_stream_admission(spark, sf):
    """ST1 + ST4: admission (scan, isolation, tool scoping, keyed W1 state,
    P16) over a request stream = the batch admission."""
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.streaming.jobs import file_stream, run_to_parquet, stage_time_ordered, stream_admission
    base = _admission_base(spark, sf)
    glob = stage_time_ordered(base, "ts", scratch_path(spark, f"staged/stream_admission/{uuid.uuid4().hex}"), tie="request_id")
    s = stream_admission(file_stream(spark, glob, base.schema), FX.tenant_config(spark), window_s=RL_WINDOW_S)
    out = run_to_parquet(s, spark, "stream_admission")
    return out.select("request_id", "tenant_id", "status", "reason", "window_count")


@register("stream_ttl_counter", f"""
WITH e AS (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events),
g AS (
  SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {TTL_S}::BIGINT * 1000000 THEN 1 ELSE 0 END AS brk
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
       row_number() OVER (PARTITION BY user_id, sid ORDER BY t, event_id) AS counter
FROM s""")
def q_stream_ttl_counter(spark, sf):
    """ST5: W3 as keyed streaming state = the batch ttl_counter."""
    from tokenledger.streaming.jobs import run_to_parquet, stream_ttl_counter
    ev = _staged_events(spark, sf, "stream_ttl")
    out = run_to_parquet(stream_ttl_counter(ev, "user_id", TTL_S), spark, "stream_ttl_counter")
    return out.select("event_id", "user_id", "counter")


@register("stream_sessions", f"""
WITH e AS (SELECT event_id, user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events),
g AS (
  SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {TTL_S}::BIGINT * 1000000 THEN 1 ELSE 0 END AS brk
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT CAST(user_id AS VARCHAR) AS user_id, MIN(t) AS start_us, MAX(t) AS end_us, COUNT(*) AS events
FROM s GROUP BY user_id, sid""")
def q_stream_sessions(spark, sf):
    """ST5: W3's sessions by a watermarked session window = the batch sessions.

    A closing event (no user) far behind the last one moves the watermark past every session."""
    import uuid
    from tokenledger.session import scratch_path
    from tokenledger.streaming.jobs import file_stream, run_to_parquet, stage_time_ordered, stream_sessions
    ev = read_table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    close = ev.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(2 * TTL_S + 86_400))).alias("ts"))
    ev = ev.unionByName(close.select(F.lit(None).cast(ev.schema["user_id"].dataType).alias("user_id"), "ts"))
    glob = stage_time_ordered(ev, "ts", scratch_path(spark, f"staged/stream_sessions/{uuid.uuid4().hex}"))
    out = run_to_parquet(stream_sessions(file_stream(spark, glob, ev.schema), "user_id", TTL_S, "1 minute"), spark,
                         "stream_sessions")
    return out.filter("user_id is not null").select("user_id", F.unix_micros("session_start").alias("start_us"),
                                                    F.unix_micros("session_end").alias("end_us"), "events")


@register("stream_usage_updates", _with(O.AUDIT_CTE) + O.rollup_sql("audit"))
def q_stream_usage_updates(spark, sf):
    """ST3: the rollup as a watermarked streaming aggregate in update mode = batch rollup."""
    from tokenledger.streaming.jobs import run_usage_updates
    audit = FX.audit_from_events(_staged_events(spark, sf, "stream_usage_updates"))
    return run_usage_updates(audit, spark, "stream_usage_updates")[0].select(*R.KEYS, *R.COUNTERS)


# ---------------------------------------------------------------- J2 (table form), V3
@register("price_lookup", _with(f"""
m AS (SELECT {O.model_case()} AS model, COUNT(*) AS requests,
             SUM(CAST(floor(value * 10) AS BIGINT)) AS prompt_tokens FROM events GROUP BY 1)""") + f"""
SELECT model, {O.provider_case('model')} AS provider, requests,
       {O.price_case('model', O.provider_case('model'), 0)} AS price_in,
       {O.price_case('model', O.provider_case('model'), 1)} AS price_out,
       CAST(CAST(prompt_tokens AS DECIMAL(20,0)) * {O.price_case('model', O.provider_case('model'), 0)} AS DECIMAL(30,5))
         AS prompt_cost_per_1k
FROM m""")
def q_price_lookup(spark, sf):
    """J2 in table form: per-model traffic joined to the price dimension, with
    the provider default row when the model is not listed."""
    from tokenledger.functions.pricing import PRICE_TYPE, price_table
    from tokenledger.operators.dimensions import lookup_join
    m = (read_table(spark, sf, "events")
         .groupBy(FX.fixture_model().alias("model"))
         .agg(F.count(F.lit(1)).alias("requests"),
              F.sum(F.floor(F.col("value") * 10).cast("bigint")).alias("prompt_tokens"))
         .withColumn("provider", provider_of("model")))
    prices = price_table(spark)
    listed = prices.filter(F.col("model").isNotNull())
    defaults = prices.filter(F.col("model").isNull()).select(
        "provider", F.col("price_in").alias("d_in"), F.col("price_out").alias("d_out"))
    j = lookup_join(m, listed, ["provider", "model"], "left")
    j = lookup_join(j, defaults, "provider", "left")
    pin = F.coalesce("price_in", "d_in").cast(PRICE_TYPE)
    pout = F.coalesce("price_out", "d_out").cast(PRICE_TYPE)
    return j.select("model", "provider", "requests", pin.alias("price_in"), pout.alias("price_out"),
                    (F.col("prompt_tokens").cast("decimal(20,0)") * pin).cast("decimal(30,5)").alias("prompt_cost_per_1k"))


INDEX_SPLIT_MIN = 300      # entries written in the first 300 minutes form the existing index


@register("index_append", _with(O.EMB_CTE) + f""",
old AS (SELECT response_id, seq FROM idx_all WHERE inserted_at < TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {INDEX_SPLIT_MIN} MINUTE),
new AS (
  SELECT 'r' || sha256(CAST(seq + 1000000 AS VARCHAR)) AS response_id,
         (SELECT COALESCE(MAX(seq), -1) FROM old) + row_number() OVER (ORDER BY inserted_at, seq + 1000000) AS seq
  FROM idx_all WHERE inserted_at >= TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {INDEX_SPLIT_MIN} MINUTE)
SELECT response_id, seq FROM old UNION ALL SELECT response_id, seq FROM new""")
def q_index_append(spark, sf):
    """V3: later writes appended to the index with ids derived from the request
    id and ``seq`` continuing after the existing maximum."""
    from tokenledger.operators.similarity import append_entries
    idx = FX.index_from_embeddings(_emb(spark, sf))
    split = F.lit(FX.INDEX_EPOCH).cast("timestamp") + F.expr(f"INTERVAL {INDEX_SPLIT_MIN} MINUTES")
    old = idx.filter(F.col("inserted_at") < split)
    new = idx.filter(F.col("inserted_at") >= split).select(
        (F.col("seq") + 1_000_000).alias("request_id"), "embedding", "inserted_at")
    return append_entries(old, new).select("response_id", "seq")
