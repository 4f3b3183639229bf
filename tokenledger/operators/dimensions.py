"""Dimension lookups (J1 tenant config, J2 price, J3 fallback, J6 seed).

A dimension is broadcast only when its size is measured: every task counts the
rows of its partition and the bytes their values take as JSON text, free text
included, and one row a task is added up; no rows move. Beyond either limit the join is
left to Catalyst/AQE as a shuffle join on the key, which is the right plan when
the dimension itself is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(dim: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``dim`` has at most ``max_rows`` rows whose values take at most ``max_bytes`` bytes."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*dim.columns))).cast("bigint"))
    rows, found = dim.agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (found or 0) <= max_bytes


def lookup_join(df: DataFrame, dim: DataFrame, on, how: str = "left",
                max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Left (or inner/semi/anti) join to a dimension, broadcasting it only when
    its rows and bytes are measured to be few."""
    if fits_broadcast(dim, max_rows):
        dim = F.broadcast(dim)
    return df.join(dim, on, how)
