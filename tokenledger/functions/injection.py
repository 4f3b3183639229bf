"""Prompt-injection scan (P7 one text, P8 a message array).

The result is the *original* text of the first pattern, in list order, that
matches anywhere in the text (case-insensitive); null means safe. Null or
blank text is safe. A CASE chain evaluates patterns in order and stops at
the first hit, all inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger import constants as K
from tokenledger.functions.text import WS, is_blank


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_pattern(p: str) -> str:
    """Python ``re.IGNORECASE`` semantics in Java regex: Unicode case folding and
    Python's whitespace class in place of ``\\s``."""
    return "(?iu)" + p.replace(r"\s", WS)


JAVA_PATTERNS = [java_pattern(p) for p in K.INJECTION_PATTERNS]


def scan_text(text) -> Column:
    """First matching pattern text, or null when safe."""
    t = _col(text)
    chain = None
    for src, jp in zip(K.INJECTION_PATTERNS, JAVA_PATTERNS):
        chain = (F.when(t.rlike(jp), F.lit(src)) if chain is None
                 else chain.when(t.rlike(jp), F.lit(src)))
    return F.when(is_blank(t), F.lit(None).cast("string")).otherwise(chain)


def _message_hit(m: Column, with_parts: bool) -> Column:
    hit = scan_text(m["content"])
    if not with_parts:
        return hit
    part_hit = F.aggregate(
        F.coalesce(m["parts"], F.array().cast("array<struct<type:string,text:string>>")),
        F.lit(None).cast("string"),
        lambda acc, p: F.coalesce(acc, F.when(p["type"] == "text", scan_text(p["text"]))))
    # string content is scanned; list content (parts) only when content is absent
    return F.when(m["content"].isNotNull(), hit).otherwise(part_hit)


def scan_messages(messages, with_parts: bool = False) -> Column:
    """First hit in message order (then part order, then pattern order).

    ``aggregate`` with ``coalesce`` stops scanning once a message has hit.
    """
    return F.aggregate(_col(messages), F.lit(None).cast("string"),
                       lambda acc, m: F.coalesce(acc, _message_hit(m, with_parts)))
