"""DuckDB SQL for the oracle check: the same adapters and operators written as
plain SQL over the driver's views (events, conversations, embeddings, ...).

CTE fragments are composed per query in ``tokenledger.plans.catalog``.
"""

from __future__ import annotations

from tokenledger import constants as K
from tokenledger.functions.pricing import PRICE_TYPE, TOKEN_TYPE
from tokenledger.plans.fixtures import FIXTURE_MODELS, TENANT_ROWS


def _q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def model_case(id_col: str = "event_id") -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(FIXTURE_MODELS))
    return f"(CASE {id_col} % 7 {whens} END)"


def provider_case(model: str) -> str:
    return f"(CASE WHEN starts_with({model}, {_q(K.ANTHROPIC_PREFIX)}) THEN 'anthropic' ELSE 'openai' END)"


def price_case(model: str, provider: str, which: int) -> str:
    whens = []
    for table in (K.OPENAI_PRICES, K.ANTHROPIC_PRICES):
        for m, prices in table.items():
            whens.append(f"WHEN {model} = {_q(m)} THEN CAST({prices[which]} AS {PRICE_TYPE})")
    default = (f"CASE WHEN {provider} = 'anthropic' THEN CAST({K.ANTHROPIC_DEFAULT_PRICE[which]} AS {PRICE_TYPE}) "
               f"ELSE CAST({K.OPENAI_DEFAULT_PRICE[which]} AS {PRICE_TYPE}) END")
    return f"(CASE {' '.join(whens)} ELSE {default} END)"


def cost_expr(model: str, provider: str, prompt: str, completion: str) -> str:
    return (f"CAST(ROUND((CAST({prompt} AS {TOKEN_TYPE}) * {price_case(model, provider, 0)} + "
            f"CAST({completion} AS {TOKEN_TYPE}) * {price_case(model, provider, 1)}) * CAST(0.001 AS DECIMAL(4,3)), 6) "
            f"AS DECIMAL(12,6))")


def fallback_case(provider: str, model: str) -> str:
    parts = []
    for prov, table in (("openai", K.OPENAI_FALLBACK), ("anthropic", K.ANTHROPIC_FALLBACK)):
        for m, f in table.items():
            parts.append(f"WHEN {provider} = '{prov}' AND {model} = {_q(m)} THEN {_q(f)}")
    return f"(CASE {' '.join(parts)} END)"


K_EXPR = "CAST(json_extract(props, '$.k') AS INTEGER)"
TENANT_EXPR = "('tenant_' || CAST(user_id % 10 AS VARCHAR))"

AUDIT_CTE = f"""
audit_base AS (
  SELECT event_id AS request_id,
         CAST(ts AS TIMESTAMP) AS created_at,
         {TENANT_EXPR} AS tenant_id,
         event_type,
         {model_case()} AS model,
         {provider_case(model_case())} AS routed,
         CAST(CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE floor(value * 10) END AS INTEGER) AS prompt_tokens,
         CAST(CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE {K_EXPR} END AS INTEGER) AS completion_tokens,
         CAST(CASE WHEN event_type = 'view' THEN NULL ELSE floor(value * 100) END AS INTEGER) AS latency_ms
  FROM events
),
audit AS (
  SELECT request_id, created_at, tenant_id,
         CASE WHEN event_type = 'view' THEN 'cache' ELSE routed END AS provider,
         model, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens,
         latency_ms,
         CASE WHEN event_type = 'view' THEN NULL
              ELSE {cost_expr('model', 'routed', 'prompt_tokens', 'completion_tokens')} END AS cost_usd,
         event_type = 'view' AS cache_hit,
         CASE WHEN event_type = 'error' THEN 'upstream timeout' END AS error_message
  FROM audit_base
)"""


def rollup_sql(source: str) -> str:
    return f"""
  SELECT tenant_id, CAST(created_at AS DATE) AS "date", provider,
         COUNT(*) AS total_requests,
         CAST(SUM(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
         CAST(SUM(completion_tokens) AS BIGINT) AS total_completion_tokens,
         CAST(SUM(COALESCE(cost_usd, 0)) AS DECIMAL(22,6)) AS total_cost_usd,
         COUNT(*) FILTER (WHERE cache_hit) AS cache_hits,
         COUNT(*) FILTER (WHERE error_message IS NOT NULL AND error_message <> '') AS errors
  FROM {source}
  GROUP BY 1, 2, 3"""


def tenants_cte() -> str:
    rows = ", ".join(
        f"({_q(t)}, {'NULL' if r is None else r}, {'NULL' if a is None else str(a).upper()}, {_q(o)})"
        for t, r, a, o in TENANT_ROWS)
    return (f"tenant_config AS (SELECT * FROM (VALUES {rows}) "
            f"AS t(tenant_id, rate_limit_rpm, allow_tool_calls, system_prompt_override))")


ATTEMPTS_CTE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         {model_case()} AS model
  FROM events WHERE event_type <> 'view'
),
ev2 AS (
  SELECT *, {provider_case('model')} AS provider FROM ev
),
attempts AS (
  SELECT event_id AS request_id, {TENANT_EXPR} AS tenant_id, 1 AS attempt_no, provider, model,
         event_type <> 'error' AS ok,
         CASE WHEN event_type = 'error' THEN 'upstream timeout' END AS error,
         CAST(floor(value * 100) AS INTEGER) AS latency_ms,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 10) END AS INTEGER) AS prompt_tokens,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE {K_EXPR} END AS INTEGER) AS completion_tokens
  FROM ev2
  UNION ALL
  SELECT event_id, {TENANT_EXPR}, 2, {provider_case(fallback_case('provider', 'model'))},
         {fallback_case('provider', 'model')},
         event_id % 2 = 0,
         CASE WHEN event_id % 2 <> 0 THEN 'fallback timeout' END,
         CAST(floor(value * 50) AS INTEGER),
         CAST(CASE WHEN event_id % 2 = 0 THEN floor(value * 10) ELSE 0 END AS INTEGER),
         CAST(CASE WHEN event_id % 2 = 0 THEN {K_EXPR} ELSE 0 END AS INTEGER)
  FROM ev2 WHERE event_type = 'error' AND {fallback_case('provider', 'model')} IS NOT NULL
)"""


def sql_str(s: str | None) -> str:
    """SQL literal; newlines spelled as chr(10)."""
    if s is None:
        return "NULL"
    parts = [_q(p) for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


# Python whitespace as an RE2 class (DuckDB), equal to str.strip()'s set.
WS_RE2 = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NONWS_RE2 = r"[^\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+\\z', '', 'g')"


def blank_sql(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, '{NONWS_RE2}'))"


def scan_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {_q(p)}, 'i') THEN {_q(p)}" for p in K.INJECTION_PATTERNS)
    return f"(CASE WHEN {blank_sql(x)} THEN NULL {whens} END)"


def planted_cte() -> str:
    from tokenledger.plans.fixtures import PLANTED
    arr = "[" + ", ".join(sql_str(p) for p in PLANTED) + "]"
    return f"""
st AS (
  SELECT conv_id, turn, role,
         CASE WHEN k < {len(PLANTED)} THEN text || ' ' || {arr}[k + 1] ELSE text END AS text
  FROM (SELECT *, CAST((conv_id * 8 + turn) % 13 AS INTEGER) AS k FROM conversations)
)"""


def message_turns_cte() -> str:
    return f"""
mt AS (
  SELECT c.conv_id, 'tenant_' || CAST(c.conv_id % 10 AS VARCHAR) AS tenant_id, c.turn,
         CASE WHEN c.role = 'system' OR c.turn IN (3, 5) THEN 'system' ELSE c.role END AS role,
         CASE WHEN c.turn = 5 AND c.conv_id % 3 = 0 THEN COALESCE(t.system_prompt_override, c.text)
              ELSE c.text END AS content,
         t.system_prompt_override AS ov
  FROM conversations c LEFT JOIN tenant_config t ON t.tenant_id = 'tenant_' || CAST(c.conv_id % 10 AS VARCHAR)
),
msgs AS (
  SELECT conv_id, tenant_id, any_value(ov) AS ov,
         list({{'role': role, 'content': content}} ORDER BY turn) AS messages
  FROM mt GROUP BY conv_id, tenant_id
)"""


def isolate_sql(msgs: str, ov: str) -> str:
    nl2 = "chr(10) || chr(10)"
    merged = (f"list_reduce(list_filter({msgs}, lambda x: COALESCE(x.role, '') = 'system'), "
              f"lambda acc, x: CASE WHEN {strip_sql('COALESCE(x.content, %s)' % _q(''))} = '' "
              f"OR contains(acc, {strip_sql('COALESCE(x.content, %s)' % _q(''))}) THEN acc "
              f"ELSE acc || {nl2} || {strip_sql('COALESCE(x.content, %s)' % _q(''))} END, {strip_sql(ov)})")
    return (f"(CASE WHEN {blank_sql(ov)} THEN {msgs} ELSE list_concat([{{'role': 'system', 'content': {merged}}}], "
            f"list_filter({msgs}, lambda x: COALESCE(x.role, '') <> 'system')) END)")


def anchored_cte(seq: str, window_s: int) -> str:
    """W1 as a recursive CTE over ``seq(tenant_id, request_id, t, rn)`` (t in us)."""
    w = f"{int(window_s)}::BIGINT * 1000000"
    return f"""
rl AS (
  SELECT tenant_id, rn, request_id, t AS anchor, CAST(1 AS BIGINT) AS n FROM {seq} WHERE rn = 1
  UNION ALL
  SELECT s.tenant_id, s.rn, s.request_id,
         CASE WHEN s.t >= r.anchor + {w} THEN s.t ELSE r.anchor END,
         CASE WHEN s.t >= r.anchor + {w} THEN CAST(1 AS BIGINT) ELSE r.n + 1 END
  FROM rl r JOIN {seq} s ON s.tenant_id = r.tenant_id AND s.rn = r.rn + 1
)"""


def limited_requests_cte(source: str) -> str:
    """``source(request_id, ts, tenant_id)`` joined to the tenant limits and
    ranked per tenant (limit > 0 only)."""
    return f"""
jr AS (
  SELECT r.*, COALESCE(c.rate_limit_rpm, 60) AS limit_rpm
  FROM {source} r LEFT JOIN tenant_config c ON r.tenant_id = c.tenant_id
),
seq AS (
  SELECT tenant_id, request_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY tenant_id ORDER BY ts, request_id) AS rn
  FROM jr WHERE limit_rpm > 0
)"""


def sim_sql(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))"
            f" + 1e-9))")


def norm_sql(a: str) -> str:
    return f"sqrt(list_dot_product({a}, {a}))"


EMB_CTE = """
emb AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nmax AS (SELECT MAX(vec_id) + 1 AS n FROM embeddings),
qv AS MATERIALIZED (
  SELECT a.vec_id AS query_id, a.v AS self_vec, b.v AS next_vec,
         list_transform(list_zip(a.v, b.v),
           lambda p: (1.0::DOUBLE - 0.1::DOUBLE * CAST(a.vec_id % 5 AS DOUBLE)) * p[1]
                     + 0.1::DOUBLE * CAST(a.vec_id % 5 AS DOUBLE) * p[2]) AS q,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(a.vec_id AS BIGINT)) AS ts
  FROM emb a JOIN emb b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM nmax)
),
idx_all AS (
  SELECT 'r' || CAST(vec_id AS VARCHAR) AS response_id, vec_id AS seq, v,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id AS BIGINT)) AS inserted_at
  FROM emb
),
asof_t AS (SELECT MAX(inserted_at) + INTERVAL 1 MINUTE AS as_of FROM idx_all),
sess AS (
  SELECT *, CASE WHEN lag(inserted_at) OVER (ORDER BY inserted_at, seq) IS NULL
                   OR inserted_at - lag(inserted_at) OVER (ORDER BY inserted_at, seq) >= INTERVAL 7 DAY
                 THEN 1 ELSE 0 END AS brk
  FROM idx_all WHERE inserted_at <= (SELECT as_of FROM asof_t)
),
cur AS (
  SELECT * FROM sess
  WHERE (inserted_at, seq) >= (SELECT MAX((inserted_at, seq)) FROM sess WHERE brk = 1)
    AND (SELECT as_of FROM asof_t) < (SELECT MAX(inserted_at) FROM sess) + INTERVAL 7 DAY
),
idx AS (SELECT response_id, seq, v, inserted_at FROM cur ORDER BY seq DESC LIMIT 500)"""
