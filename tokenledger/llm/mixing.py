"""Mixing sources to target weights, with DataFrame functions only.

1. Every document gets a hash-random key (MD5 of its id, as hex text), so the
   order inside a source is random but the same in every run.
2. The key space of each source is cut into ranges (the first hex digits of the
   key; their number follows the row count, so a hot source has as many ranges
   as it needs). Token counts are summed per (source, range) -- partial sums
   before the shuffle -- and prefix sums over ranges give every range's offset.
3. A source's budget is ``whole`` epochs of everything plus a rest. The range
   that holds the rest's end is the only one whose rows are sorted and summed;
   that gives the source's cut: the key at which the budget is spent.
4. A document compares its key with its source's cut. Only the per-source table
   is joined to the documents, so texts are never shuffled by key.

Rows equal in (key, id, size) are one group; when the cut falls in such a group
its rows share the remaining words evenly, rounded down.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.llm.staging import numbered, renamed, stage

#: words ``[^\x20\x09-\x0D]+``
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: rows of one range of the whole key space, at most; otherwise as many rows as there are ranges (their root)
ROWS_PER_RANGE = 50_000
#: a per-source table of up to so many rows is broadcast (about 150 bytes a row)
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_key(doc_id: Column) -> Column:
    """The document's place in its source's random order, as 32 hex digits."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _prefix(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Exclusive prefix sums of ``sums`` over the whole table in ``order``.

    A range-partitioned sort, staged, then one offset per partition: no task
    sees more than one partition's rows.
    """
    parts = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = parts.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    over_parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row a partition
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(over_parts), F.lit(0)).alias(f"_o_{k}")
                                       for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(offsets, "_part").select(
        *df.columns, *[(F.col(f"_o_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(k)
                       for k, v in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``weight`` and ``target`` (double).

    Sources in code point order, null last, take the weights in turn and share
    the total size by weight. No target exceeds ``max_epochs`` sizes; the excess
    goes to the others by weight until none is above. That fixed point is one
    water level: by rising size/weight, sources are capped as long as their cap
    is at most the level that the rest of the total allows.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = _prefix(sizes, by_name, {"rank": F.lit(1)}, "mix-rank")
    ranked = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                               (F.col("rank") % len(weights) + 1).cast("int")).cast("bigint")).drop("rank")
    cap = F.col("source_size") * max_epochs
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"),
                       F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    level = _prefix(ranked, [F.col("source_size") / F.col("weight"), *by_name],
                    {"_caps": cap, "_weights": F.col("weight")}, "mix-level")
    level = level.withColumn("_level", (F.lit(int(whole["s"])) - F.col("_caps"))
                             / (F.lit(int(whole["w"])) - F.col("_weights")))
    free = level.filter(cap / F.col("weight") > F.col("_level"))
    first = free.agg(F.min_by("_level", F.struct(F.col("source_size") / F.col("weight"),
                                                 F.col("source").isNull(), F.col("source"))).alias("l")).first()
    water = F.lit(None if first is None else first["l"]).cast("double")
    return ranked.select("source", "source_size", "weight",
                         F.least(cap.cast("double"), F.col("weight") * water).alias("target"))


def source_cuts(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: size, target, whole epochs, and where the rest ends.

    ``sized`` needs doc_id, source, size. ``cut_*`` name the group of rows in
    which the budget ends and the words each of its rows gives; they are null
    where no rest is left over or the source is empty.
    """
    rows = sized.select("source", "doc_id", "size", hash_key(F.col("doc_id")).alias("key"))
    n = max(1, rows.count())
    per_range = max(1, min(ROWS_PER_RANGE, math.isqrt(n)))
    digits = max(0, math.ceil(math.log(n / per_range, 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits) if digits else F.lit(""))
    sums = stage(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    sizes = sums.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    plan = source_targets(sizes, weights, max_epochs)
    budget = F.round("target").cast("bigint")
    plan = stage(plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
                                 .otherwise(F.lit(0)).cast("bigint"))
                 .withColumn("rest", budget - F.col("whole") * F.col("source_size")), "mix-plan")
    over_ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("range_size").over(over_ranges), F.lit(0)))
    p = plan.select(F.col("source").alias("_s"), "rest")
    last = (before.join(p, F.col("source").eqNullSafe(F.col("_s")))
            .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("range_size")))
            .select(F.col("source").alias("_s"), F.col("range").alias("_r"), "before", "rest"))
    groups = (rows.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
              .groupBy("source", "range", "before", "rest", "key", "doc_id", "size")
              .agg(F.count(F.lit(1)).alias("copies")))
    inside = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    upto = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    cut = (groups.withColumn("upto", upto)
           .filter((F.col("upto") <= F.col("rest"))
                   & (F.col("rest") < F.col("upto") + F.col("size") * F.col("copies")))
           .select(F.col("source").alias("_s"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"),
                   F.col("size").alias("cut_size"),
                   F.floor((F.col("rest") - F.col("upto")) / F.col("copies")).cast("bigint").alias("cut_words")))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS,
                max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words, repeats counted).

    ``docs`` needs doc_id, source and text (or a ``size`` column expression).
    Defined cases: a null text has size 0 and takes 0; rows with a null source
    form the last source; null ids sort as one group of the empty key; repeated
    rows count each; an empty table gives an empty result; other columns pass
    through (those named like an added column are replaced).
    """
    made = ("size", "source_size", "target", "taken")
    passengers = [c for c in docs.columns if c not in made]
    words = word_count(F.col("text")) if size is None else size.cast("bigint")
    named = docs.select("doc_id", "source", words.alias("size"), *numbered(passengers))
    sized = stage(named.select("doc_id", "source", "size"), "mix-sizes")
    if set(passengers) == {"doc_id", "source"}:
        named = sized.select("doc_id", "source", "size", *numbered(passengers))
    cuts = stage(source_cuts(sized, weights, max_epochs), "mix-cuts").select(
        F.col("source").alias("_source"), "source_size", "target", "whole", "rest",
        "cut_key", "cut_id", "cut_size", "cut_words")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    return apply_cuts(named, cuts).select(*renamed(passengers), *made)


def apply_cuts(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    joined = docs.join(cuts, F.col("source").eqNullSafe(F.col("_source")))

    def place(key: Column, doc_id: Column, size: Column) -> Column:
        return F.struct(key.alias("k"), doc_id.isNotNull().alias("n"), doc_id.alias("d"), size.alias("s"))

    mine = place(hash_key(F.col("doc_id")), F.col("doc_id"), F.col("size"))
    cut = place(F.col("cut_key"), F.col("cut_id"), F.col("cut_size"))
    extra = (F.when(F.col("cut_key").isNull() | (F.col("rest") == 0), F.lit(0))
             .when(mine.eqNullSafe(cut), F.col("cut_words")).when(mine < cut, F.col("size")).otherwise(F.lit(0)))
    return (joined.withColumn("taken", (F.col("whole") * F.col("size") + extra).cast("bigint"))
            .drop("_source", "whole", "rest", "cut_key", "cut_id", "cut_size", "cut_words"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * (
          SELECT min_by(level, source_size / weight) FROM l WHERE 3 * source_size / weight > level)) AS target FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM t),
g AS (SELECT source, key, doc_id, size, count(*) AS copies FROM d GROUP BY ALL),
c AS (SELECT g.*, p.source_size, p.target, p.whole, round(p.target)::BIGINT - p.whole * p.source_size AS rest,
             coalesce(sum(size * copies) OVER (PARTITION BY g.source ORDER BY key, doc_id NULLS FIRST, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
m AS (SELECT *, whole * size + CASE WHEN rest <= upto THEN 0 WHEN rest >= upto + size * copies THEN size
                                    ELSE (rest - upto) // copies END AS taken FROM c)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM m, range(copies)
"""
