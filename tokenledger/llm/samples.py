"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage
from tokenledger.llm.textblocks import ALNUM_WORD, blocks


def held_out(doc_id: Column) -> Column:
    """The fifth of documents that no model sees: crc32(id as text) mod 5 = 0 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def some_texts(docs: DataFrame, n: int, max_bytes: int = 65_536) -> list[str]:
    """At most ``n`` texts of at most ``max_bytes`` bytes, spread by their hash over the first partitions.

    Partitions are read only until there are enough, so this does not scan the table.
    """
    spread = F.pmod(F.xxhash64("text"), F.lit(16)) == 0
    return [r["text"] for r in docs.select("text").filter((F.octet_length("text") <= max_bytes) & spread).take(n)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int
                    ) -> tuple[pa.Table, dict[int, int]]:
    """(text, n_chars, label) of at most ``per_class`` training rows of each class,
    and the number of training labels of each class.

    The ids come by the smallest id hash from those that have a text of at most
    ``max_bytes``; an id gives one row, its text of the smallest hash, however often
    it stands in the documents or the labels (with both labels it is of class 1). At
    most 2 x per_class x max_bytes bytes reach the driver.
    """
    train = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).select(
        "doc_id", F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}       # two rows
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    fitting = docs.filter(F.octet_length("text") <= max_bytes)
    once = train.groupBy("doc_id").agg(F.max("label").alias("label"))
    there = stage(once.join(fitting.select("doc_id").distinct(), "doc_id"), "sample-ids")        # ids, no texts
    picked = None
    for value in (0, 1):
        part = there.filter(F.col("label") == value).orderBy(*by_hash).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    text = F.struct(F.xxhash64("text").alias("hash"), "text", "n_chars")
    rows = (fitting.select("doc_id", "text", "n_chars").join(F.broadcast(picked), "doc_id")      # 2 x per_class ids
            .groupBy("doc_id", "label").agg(F.min(text).alias("one")).orderBy("doc_id"))
    return rows.select("one.text", "one.n_chars", "label").toArrow(), sizes


def without_copies(texts: pa.Array, sketch: int = 16) -> np.ndarray:
    """Rows of a sample that are no near copies of an earlier one.

    A text's sketch is its ``sketch`` smallest 5-gram hashes; a text that shares half of it with an earlier
    text is a copy (its words would count once for every copy). Texts without 5-grams are kept.
    """
    owner: dict[int, int] = {}
    keep, i = [], 0
    for b in blocks(texts, ALNUM_WORD, lower=True):
        at, h = b.gram_hashes(b.word_hashes(), 5)
        cuts = np.searchsorted(b.doc[at], np.arange(b.n + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            low = np.unique(h[lo:hi])[:sketch].tolist()
            seen = [owner[x] for x in low if x in owner]
            if not seen or 2 * max(map(seen.count, set(seen))) < len(low):
                keep.append(i)
                owner.update((x, i) for x in low if x not in owner)
            i += 1
    return np.array(keep, dtype=np.int64)
