"""Parquet table readers.

Reading is lazy: Catalyst prunes columns to what the query uses and pushes
filters into the scan, so callers never pre-select by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``. ``events.ts`` is stored as TIMESTAMP_NTZ;
    it is cast to TIMESTAMP (session zone UTC) so watermarks and date functions
    accept it."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df

