"""Ranked lexical search, reversed: the items wait in an index and the documents stream by.

The items' terms form an inverted index (term -> items that hold it, with counts)
that is broadcast. One scan of the documents looks every word up in the index's
vocabulary -- by its 64-bit hash, confirmed byte by byte -- and writes each
document's length and the counts of the terms that some item holds; the corpus
statistics come from these. A second pass streams the written term counts through
the index: every document scores with the items it shares a term with, and each
task keeps a bounded heap per item. The heaps are merged in Spark, first over groups
of tasks and then over all.

What is broadcast grows with the items alone and is bounded: items whose terms
exceed ``BLOCK_TERMS`` entries (a long term counts as several) are dealt into blocks
by a hash of their row, and each block is a search of its own over all documents.
Chunks of documents are scored against ``CELLS`` cells at a time. A single item's
terms and a single text must fit a task.

Defined cases: a null or empty text has no terms; an item without terms, or whose
terms no document holds, has no rows in the result; no documents, no rows. Each row
of the items is an item, repeated ids too, and each row of the documents a document:
repeated rows take ranks of their own. Equal scores rank by ascending doc_id, null ids
last. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage
from tokenledger.llm.textblocks import ALNUM_WORD, Block, blocks

TOP = 10
#: entries of a broadcast index: about 40 bytes each
BLOCK_TERMS = 2_000_000
#: document x item cells, and postings, worked on at a time
CELLS = 1 << 21
#: groups of tasks whose heaps are merged first
MERGE_GROUPS = 64


@dataclass
class Index:
    """Terms 0 .. by hash: ``hashes`` (rising), bytes ``data[bounds[t]:bounds[t + 1]]``, items
    ``post_item[starts[t]:starts[t + 1]]`` with counts ``post_count``; ``items``: their staged row ids."""
    hashes: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    post_item: np.ndarray
    post_count: np.ndarray
    items: np.ndarray
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0

    def __len__(self) -> int:
        return len(self.hashes)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item (a row id), item_id, term, count of every item and distinct term."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2), ALNUM_WORD, lower=True):
                counts: dict[tuple[int, bytes], int] = {}
                for doc, s, e in zip(b.doc.tolist(), b.starts.tolist(), b.ends.tolist()):
                    key = (doc, b.data[s:e].tobytes())
                    counts[key] = counts.get(key, 0) + 1
                at = pa.array([b.first + doc for doc, _ in counts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array([t for _, t in counts], pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], ["item", "item_id", "term", "count"])

    id_type = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(
        split, f"item long, item_id {id_type}, term binary, count long")


def build_index(terms: DataFrame) -> Index:
    """The index of one block of items (item, term, count): at most about BLOCK_TERMS rows."""
    rows = terms.select("item", "term", "count").toArrow().combine_chunks()
    words = rows.column("term").combine_chunks().dictionary_encode() if rows.num_rows else pa.array(
        [], pa.binary()).dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    vocabulary = words.dictionary.to_pylist()
    hashes = np.zeros(len(vocabulary), np.uint64)
    for b in blocks(pa.array([w.decode() for w in vocabulary], pa.large_string()), ALNUM_WORD):
        hashes[b.first:b.first + b.n] = b.word_hashes()              # a term is one word
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    term = place[words.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    items, item = np.unique(rows.column("item").to_numpy(), return_inverse=True)
    by_term = np.argsort(term, kind="stable")
    sizes = [len(vocabulary[i]) for i in order.tolist()]
    return Index(hashes[order], np.append(0, np.cumsum(sizes)).astype(np.int64),
                 np.frombuffer(b"".join(vocabulary[i] for i in order.tolist()), np.uint8),
                 np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1)), item[by_term].astype(np.int64),
                 rows.column("count").to_numpy()[by_term].astype(np.int64), items)


def _same_bytes(b: Block, word: np.ndarray, index: Index, term: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of its term."""
    size = b.ends[word] - b.starts[word]
    same = size == index.bounds[term + 1] - index.bounds[term]
    word, term, size, at = word[same], term[same], size[same], np.flatnonzero(same)
    if len(word):
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = (b.data[np.repeat(b.starts[word], size) + inside]
                   != index.data[np.repeat(index.bounds[term], size) + inside])
        same[at[np.add.reduceat(differs, np.cumsum(size) - size) > 0]] = False
    return same


def look_up(b: Block, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(words of the block that are terms of the index, their terms)."""
    if not len(index) or not len(b.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = b.word_hashes()
    at = np.searchsorted(index.hashes, h)
    words, terms = [], []
    while True:                                     # one round, but for terms of equal hash
        here = at < len(index)
        here[here] = index.hashes[at[here]] == h[here]
        if not here.any():
            break
        word = np.flatnonzero(here)
        same = _same_bytes(b, word, index, at[word])
        words.append(word[same])
        terms.append(at[word[same]])
        at = np.where(here, at + 1, len(index))
    return (np.concatenate(words), np.concatenate(terms)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def term_counts(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts (of the index's terms) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for b in blocks(batch.column(1), ALNUM_WORD, lower=True):
                word, term = look_up(b, ix)
                key, count = np.unique(b.doc[word] * max(len(ix), 1) + term, return_counts=True)
                doc, term = np.divmod(key, max(len(ix), 1))
                bounds = pa.array(np.searchsorted(doc, np.arange(b.n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), pa.array(np.diff(b.word_bounds), pa.int64()),
                     pa.ListArray.from_arrays(bounds, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(bounds, pa.array(count, pa.int32()))], ["doc_id", "n", "terms", "counts"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {id_type}, n long, terms array<int>, counts array<int>")


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: every task adds up its documents, Spark the tasks."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], ["term", "df"])

    found = counts.select("terms").mapInArrow(part, "term int, df long").groupBy("term").agg(
        F.sum("df").alias("df")).toArrow()                              # at most the index's terms
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class Heaps:
    """The best ``top`` (score, doc_id) of every item, in columns."""

    def __init__(self, n_items: int, top: int, id_type: pa.DataType) -> None:
        self.top = top
        self.least = np.ones(n_items, np.int64)            # a document must reach this score
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.doc = pa.array([], id_type)

    def add(self, scores: np.ndarray, docs: pa.Array) -> None:
        """Scores (documents x items) of some documents."""
        if len(scores) > self.top:
            kth = np.partition(scores, len(scores) - self.top, axis=0)[len(scores) - self.top]
            bar = np.maximum(self.least, kth)
        else:
            bar = self.least
        at, item = np.nonzero(scores >= bar)
        if not len(at):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[at, item]])
        doc = pa.concat_arrays([self.doc, docs.take(pa.array(at))])
        order = pc.sort_indices(pa.table({"i": item, "s": score, "d": doc}), null_placement="at_end", sort_keys=[
            ("i", "ascending"), ("s", "descending"), ("d", "ascending")]).to_numpy()
        item, score = item[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc.take(pa.array(order[keep]))
        full = rank[keep] == self.top - 1
        self.least[self.item[full]] = self.score[full]


def _chunks(bounds: np.ndarray, cost: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most CELLS cells and about as many postings."""
    total = np.append(0, np.cumsum(cost))[bounds]
    lo, n, step = 0, len(bounds) - 1, max(1, CELLS // max(1, n_items))
    while lo < n:
        hi = int(np.searchsorted(total, total[lo] + CELLS, "right")) - 1
        hi = min(max(hi, lo + 1), lo + step, n)
        yield lo, hi
        lo = hi


def best_documents(counts: DataFrame, index: Index, top: int = TOP) -> DataFrame:
    """item, doc_id, score: each task's heaps over its documents."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, heaps = shared.value, None
        n_items, spread = len(ix.items), np.diff(ix.starts)
        for batch in batches:
            heaps = heaps or Heaps(n_items, top, batch.column(0).type)
            terms = batch.column(2)
            bounds = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))).astype(np.int64)
            term = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = 100 - 75 + (75 * batch.column(1).to_numpy().astype(np.int64) * ix.n_docs) // max(ix.n_terms, 1)
            doc = np.repeat(np.arange(len(m)), np.diff(bounds))
            part = ix.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            for lo, hi in _chunks(bounds, spread[term], n_items):
                a, z = bounds[lo], bounds[hi]
                many = spread[term[a:z]]
                entry = np.repeat(np.arange(a, z), many)
                post = np.repeat(ix.starts[term[a:z]] - (np.cumsum(many) - many), many) + np.arange(len(entry))
                scores = np.zeros((hi - lo) * n_items, np.int64)
                np.add.at(scores, (doc[entry] - lo) * n_items + ix.post_item[post], part[entry] * ix.post_count[post])
                heaps.add(scores.reshape(hi - lo, n_items), batch.column(0).slice(lo, hi - lo))
        if heaps is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ix.items[heaps.item], pa.int64()), heaps.doc, pa.array(heaps.score)],
                                             ["item", "doc_id", "score"])

    id_type = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(stream, f"item long, doc_id {id_type}, score long")


def merge_heaps(heaps: DataFrame, top: int = TOP, groups: int = MERGE_GROUPS) -> DataFrame:
    """item, rank, doc_id, score: the best of all tasks' heaps, merged in two steps."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = (heaps.withColumn("group", F.spark_partition_id() % groups)
            .withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*best)))
            .filter(F.col("rank") <= top).drop("rank", "group"))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best)))
            .filter(F.col("rank") <= top).select("item", "rank", "doc_id", "score"))


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents (doc_id, text) of every item (item_id, text)."""
    terms = stage(item_terms(benchmark), "search-items")
    weight = 1 + F.floor(F.octet_length("term") / 32)
    size = terms.agg(F.sum(weight).alias("size")).first()["size"] or 0
    n_blocks = max(1, math.ceil(size / block_terms))
    out = None
    for i in range(n_blocks):
        block = terms.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)
        index = build_index(block)
        counts = stage(term_counts(docs, index), "search-counts")
        stats = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        index.n_docs, index.n_terms = stats["docs"], stats["terms"] or 0
        df = document_frequencies(counts, len(index))
        index.weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * x + 1))) for x in df.tolist()],
                                 np.int64)
        merged = merge_heaps(best_documents(counts.filter(F.size("terms") > 0), index, top), top)
        out = merged if out is None else out.unionByName(merged)
    return out.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
           FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark),
q AS (SELECT item, item_id, w, count(*) AS qtf FROM (SELECT item, item_id, unnest(words) AS w FROM i) GROUP BY ALL),
t AS (SELECT row, doc_id, n, w, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS w FROM d)
      WHERE w IN (SELECT w FROM q) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
f AS (SELECT w, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY w, nd),
r AS (SELECT item, item_id, row, doc_id,
             sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN t USING (w) JOIN f USING (w), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
