"""Text helpers with Python ``str`` semantics (strip, blank test, sanitiser P9).

Spark's ``trim`` strips ASCII spaces only and Java's ``\\s`` is ASCII only, so
whitespace is spelled out as an explicit class equal to what ``str.strip()``
and Python's ``\\s`` accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger import constants as K

# Python whitespace: ASCII \s plus FS/GS/RS/US, NEL, NBSP and the Unicode spaces.
WS_INNER = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_INNER}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), rf"^{WS}+|{WS}+\z", "")


def is_blank(c) -> Column:
    """``not text or not text.strip()``; finds the first non-space and stops."""
    c = _col(c)
    return c.isNull() | ~c.rlike(f"[^{WS_INNER}]")


def is_falsy_str(c) -> Column:
    """Python truthiness of an optional string: null or empty."""
    c = _col(c)
    return c.isNull() | (c == "")


def py_lstrip(c) -> Column:
    return F.regexp_replace(_col(c), rf"^{WS}+", "")


def py_rstrip(c) -> Column:
    return F.regexp_replace(_col(c), rf"{WS}+\z", "")


def sanitize_for_log(c, max_len: int = K.LOG_MAX_LEN) -> Column:
    """null/empty -> ''; else strip, newline -> space, first ``max_len`` code points.

    Equal to stripping the whole text first, but cheaper on long texts: after
    the left strip, the right strip can change the first ``max_len`` characters
    only when everything after them is whitespace, which a search for the first
    non-space character of the remainder decides.
    """
    c = _col(c)
    left = py_lstrip(c)
    head = F.substring(left, 1, max_len)
    tail_has_text = F.substring(left, max_len + 1, 2147483647).rlike(f"[^{WS_INNER}]")
    body = F.when(tail_has_text, head).otherwise(py_rstrip(head))
    return F.when(is_falsy_str(c), F.lit("")).otherwise(F.replace(body, F.lit("\n"), F.lit(" ")))
