"""tokenledger: model-traffic analytics and governance on Spark.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing is computed on the driver: the heavy work is expressed with
the DataFrame API so Catalyst can push filters, prune columns and plan
partial/final aggregation, and the few sequential operators run as
Arrow-batched pandas functions over bounded, Spark-partitioned groups.

Sub-packages:
  sources    readers, JSON request ingest, TTL key-value tables, sinks
  functions  column expressions (routing, pricing, text, scan, messages, vectors)
  operators  table operators (dimensions, rollup, dashboard, admission, ...)
  plans      test-data adapters and the named queries
  streaming  Structured Streaming jobs
"""

from tokenledger.session import checkpoint_dir, get_spark, ship_package  # noqa: F401

# With a session of your own, call ship_package(spark) once so the Python
# workers can import this package (get_spark does it for you).
__all__ = ["get_spark", "checkpoint_dir", "ship_package"]
