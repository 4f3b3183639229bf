"""Table-form text operators over turn tables (P6 table form, P7/P8 table form).

A turn table has one row per (conversation, turn). Per-conversation results
are computed with partial aggregates (``min_by``) or a two-level ordered string
aggregate, so a conversation with a huge number of turns is split into bounded
chunks before its final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.injection import scan_text

CHUNK_TURNS = 4096


def ordered_string_agg(df: DataFrame, key: str, order_col: str, text_col: str, sep: str = "\n",
                       out_col: str = "text", chunk: int = CHUNK_TURNS) -> DataFrame:
    """Join ``text_col`` per ``key`` in ``order_col`` order with ``sep``.

    Null texts are skipped, empty strings kept (``str.join`` over string
    contents). Stage 1 joins runs of ``chunk`` consecutive order values, stage 2
    joins the per-chunk strings, so no single group holds more than ``chunk``
    rows plus one row per chunk.
    """
    part = (df.select(key, order_col, text_col)
              .withColumn("_chunk", F.floor(F.col(order_col) / chunk))
              .groupBy(key, "_chunk")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                        F.col(text_col).alias("t")))).alias("_items")))
    part = part.select(
        key, "_chunk",
        F.when(F.size(F.filter("_items", lambda x: x["t"].isNotNull())) == 0, F.lit(None).cast("string"))
         .otherwise(F.array_join(F.transform("_items", lambda x: x["t"]), sep)).alias("_part"))
    return (part.groupBy(key)
                .agg(F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("c"),
                                                          F.col("_part").alias("p")))).alias("_parts"))
                .select(key, F.array_join(F.transform("_parts", lambda x: x["p"]), sep).alias(out_col)))


def scan_turns(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """P7 per row: adds ``pattern`` (first matching pattern text, null if safe)."""
    return turns.withColumn("pattern", scan_text(text_col))


def first_hit(scanned: DataFrame, key: str, order_col: str) -> DataFrame:
    """P8 table form: per key, the pattern of the earliest hit in ``order_col``
    order (null when no turn hits). ``min_by`` combines map-side, so hot keys
    are pre-aggregated before the shuffle."""
    hit_order = F.when(F.col("pattern").isNotNull(), F.col(order_col))
    return (scanned.groupBy(key)
            .agg(F.min_by(F.col("pattern"), hit_order).alias("pattern"),
                 F.min(hit_order).alias("first_hit_turn"),
                 F.count(F.lit(1)).alias("n_turns")))
