"""Column expressions. Each returns a ``pyspark.sql.Column``."""

from tokenledger.functions.injection import scan_messages, scan_text  # noqa: F401
from tokenledger.functions.messages import isolate_system_prompt, prompt_text, split_system  # noqa: F401
from tokenledger.functions.pricing import cost_usd, total_tokens  # noqa: F401
from tokenledger.functions.responses import native_usage, normalize_b  # noqa: F401
from tokenledger.functions.routing import fallback_model, payload_a, payload_b, provider_of  # noqa: F401
from tokenledger.functions.text import is_blank, py_strip, sanitize_for_log  # noqa: F401
from tokenledger.functions.vectors import cosine  # noqa: F401
