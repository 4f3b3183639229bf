"""Written intermediates in the folder that executors and driver share.

``stage`` writes a DataFrame as Parquet under the session's checkpoint folder
(``spark.checkpoint.dir``) and reads it back: the lineage is cut, a lost
executor loses nothing, and a table used twice is computed once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.session import checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable by Python workers."""
    ship_package(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: a staged list of up to so many row keys (64 hex digits each) is broadcast
BROADCAST_KEYS = 200_000


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(columns: list[str]) -> list[Column]:
    """Passenger columns under names that no operator uses (c0, c1, ...)."""
    return [col(c).alias(f"c{i}") for i, c in enumerate(columns)]


def renamed(columns: list[str]) -> list[Column]:
    """The passengers of ``numbered`` under their own names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]


def row_key(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> Column:
    """SHA-256 of those of ``columns`` that ``docs`` has; a null is no value of any column."""
    each = [F.coalesce(F.sha2(col(c).cast("string"), 256), F.lit("-")) for c in columns if c in docs.columns]
    return F.sha2(F.concat_ws("|", *each), 256)


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``gone`` (staged; one column, key).

    A list of a checked size is broadcast and the rows stay where they are; a longer one is joined by shuffle.
    """
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rows = docs.select(*numbered(docs.columns), key.alias("key"))
    return rows.join(gone, "key", "left_anti").select(*renamed(docs.columns))
