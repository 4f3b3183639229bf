"""Message-array functions (P6 prompt text, P11 system prompt isolation,
P12 system/turn split). All are higher-order Catalyst expressions over the
row's own array: no explode, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger.functions.text import is_blank, py_strip

MESSAGE_TYPE = "struct<role:string,content:string,name:string>"
MESSAGES_TYPE = f"array<{MESSAGE_TYPE}>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _is_system(m: Column) -> Column:
    # a missing role reads as '' here: not a system message
    return F.coalesce(m["role"], F.lit("")) == "system"


def prompt_text(messages) -> Column:
    """String contents joined by newline in message order; null contents are
    skipped, empty strings stay as empty lines."""
    return F.array_join(F.transform(_col(messages), lambda m: m["content"]), "\n")


def isolate_system_prompt(messages, override) -> Column:
    """Merge the tenant override with the request's system messages.

    Blank or null override leaves the array unchanged. Otherwise start from the
    stripped override and append each stripped, non-empty system content that is
    not already a substring of the merged text; put the merged message first and
    keep all other messages in order.
    """
    msgs, ov = _col(messages), _col(override)
    merged = F.aggregate(
        F.filter(msgs, _is_system),
        py_strip(ov),
        lambda acc, m: F.when(
            (py_strip(F.coalesce(m["content"], F.lit(""))) == "")
            | acc.contains(py_strip(F.coalesce(m["content"], F.lit("")))),
            acc,
        ).otherwise(F.concat(acc, F.lit("\n\n"), py_strip(F.coalesce(m["content"], F.lit(""))))),
    )
    head = F.array(F.struct(F.lit("system").alias("role"), merged.alias("content"),
                            F.lit(None).cast("string").alias("name")))
    rest = F.filter(msgs, lambda m: ~_is_system(m))
    return F.when(is_blank(ov), msgs).otherwise(F.concat(head, rest))


def split_system(messages) -> tuple[Column, Column]:
    """(system text, non-system turns) for provider B.

    The last system message wins; null content reads as ''; a missing role is
    'user'. Each turn keeps (role, content).
    """
    msgs = _col(messages)
    norm = F.transform(msgs, lambda m: F.struct(
        F.coalesce(m["role"], F.lit("user")).alias("role"),
        F.coalesce(m["content"], F.lit("")).alias("content")))
    systems = F.filter(norm, lambda m: m["role"] == "system")
    system_text = F.coalesce(F.try_element_at(systems, F.lit(-1))["content"], F.lit(""))
    turns = F.filter(norm, lambda m: m["role"] != "system")
    return system_text, turns
