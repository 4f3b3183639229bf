"""Connected components of an edge table by alternating star contractions.

Each round first links every node's larger neighbours to its smallest neighbour,
then every node's smaller neighbours and itself to the smallest of them, until
the table stands still: every edge then leads from a node to the smallest node
of its component. A round is two aggregations and two joins over the edges; its
result is staged, so nothing is collected and a lost executor loses no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .filter("u <> v").distinct())
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, u: str, v: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has an edge; the root is the component's smallest node."""
    now = stage(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    seen = _fingerprint(now)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        now = stage(_round(now), "edges")
        last, seen = seen, _fingerprint(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
