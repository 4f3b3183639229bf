"""Fixed values that must equal the service we mirror for results to agree.

FIXED VALUES -- do not edit: prices, fallbacks, patterns and limits below are
the behaviour being reproduced. They are stated plainly, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: model price per 1K tokens in USD, (input, output).
# ---------------------------------------------------------------------------
OPENAI_PRICES = {
    "gpt-4": ("0.03", "0.06"),
    "gpt-4-turbo": ("0.01", "0.03"),
    "gpt-4o": ("0.005", "0.015"),
    "gpt-3.5-turbo": ("0.0005", "0.0015"),
}
OPENAI_DEFAULT_PRICE = ("0.01", "0.03")

ANTHROPIC_PRICES = {
    "claude-3-opus-20240229": ("0.015", "0.075"),
    "claude-3-sonnet-20240229": ("0.003", "0.015"),
    "claude-3-haiku-20240307": ("0.00025", "0.00125"),
    "claude-3-5-sonnet-20241022": ("0.003", "0.015"),
}
ANTHROPIC_DEFAULT_PRICE = ("0.003", "0.015")

# ---------------------------------------------------------------------------
# FIXED VALUES: one-hop fallback model per provider.
# ---------------------------------------------------------------------------
OPENAI_FALLBACK = {
    "gpt-4": "gpt-3.5-turbo",
    "gpt-4-turbo": "gpt-3.5-turbo",
    "gpt-4o": "gpt-3.5-turbo",
}
ANTHROPIC_FALLBACK = {
    "claude-3-opus-20240229": "claude-3-sonnet-20240229",
    "claude-3-5-sonnet-20241022": "claude-3-haiku-20240307",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: routing.
# ---------------------------------------------------------------------------
ANTHROPIC_PREFIX = "claude-"
DEFAULT_MODEL = "gpt-4"
DEFAULT_TENANT = "default"
TENANT_HEADER = "X-Tenant-ID"
DEFAULT_MAX_TOKENS_B = 1024          # provider B: `max_tokens or 1024`
PROVIDER_TIMEOUT_S = 60.0

# ---------------------------------------------------------------------------
# FIXED VALUES: injection patterns, in evaluation order (first match wins),
# matched case-insensitively anywhere in the text.
# ---------------------------------------------------------------------------
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+instructions",
    r"disregard\s+(your\s+)?(instructions|system\s+prompt)",
    r"you\s+are\s+now\s+",
    r"pretend\s+you\s+are\s+",
    r"act\s+as\s+if\s+you\s+are\s+",
    r"\[system\]",
    r"<\|im_start\|>",
    r"human:\s*$",
    r"assistant:\s*$",
    r"###\s*system\s*:",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: limits and lifetimes.
# ---------------------------------------------------------------------------
RATE_WINDOW_SECONDS = 60
DEFAULT_RATE_LIMIT_RPM = 60
SIMILARITY_THRESHOLD = 0.95
SIMILARITY_EPS = 1e-9                # added to the norm product
MAX_INDEX_ENTRIES = 500
INDEX_TTL_SECONDS = 86400 * 7
RESPONSE_TTL_SECONDS = 3600
LOG_MAX_LEN = 500
USAGE_DAYS_RANGE = (1, 90)
LATENCY_LIMIT_RANGE = (1, 1000)
ERRORS_LIMIT_RANGE = (1, 200)
DEFAULT_ALLOWED_MODELS = [
    "gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "claude-3-opus", "claude-3-sonnet",
]
