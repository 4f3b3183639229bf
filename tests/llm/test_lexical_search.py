"""Ranks against plain Python; heaps, blocks of items and equal hashes."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import ALNUM_WORD, SCHEMA, ascii_lower, clashing, edge_docs, rows
from tokenledger.llm import lexical_search as S
from tokenledger.llm.textblocks import ALNUM_WORD as IS_WORD, blocks


def words(text):
    return ALNUM_WORD.findall(ascii_lower(text))


def brute(docs, items, top=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted]
    n_docs, n_terms = sum(n > 0 for *_, n in counted), sum(n for *_, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, n in counted:
            if not n:
                continue
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in Counter(words(text)).items() if w in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, k, doc, -score) for k, (score, _, doc) in enumerate(sorted(
            found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha beta ALPHA gamma"), (2, None), (3, ""), (4, "line one here"), (5, "unknownword"), (6, "word Éé 中文 12345"),
         (6, "word Éé 中文 12345"), (6, "other text here"), (None, "x one"), (7, "word " * 3000), (8, "x" * 100_000),
         (9, " ".join(f"t{i}" for i in range(3000)) + " theta eta")]
ITEM_SCHEMA = "item_id long, text string"


@pytest.mark.parametrize("block_terms", [S.BLOCK_TERMS, 500])
def test_edge_documents(spark, block_terms):
    more = [(i, f"one word t{i % 50} " * (i % 7 + 1), "en", "a", 0) for i in range(200, 320)]
    df = edge_docs(spark).unionByName(spark.createDataFrame(more, SCHEMA)).repartition(4)
    items = spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows(S.search(df, items, block_terms=block_terms)) == brute(docs, ITEMS)
    if block_terms == 500:
        from pyspark.sql import functions as F
        wide = clashing(df).withColumns({c: F.lit("x") for c in ("n", "terms", "counts", "item", "term", "rank", "group")})
        assert rows(S.search(wide, items.withColumn("item", F.lit("x")).withColumn("term", F.lit(1)))) == brute(docs, ITEMS)


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEM_SCHEMA)
    items = spark.createDataFrame(ITEMS, ITEM_SCHEMA)
    assert S.search(none, items).collect() == S.search(edge_docs(spark), no_items).collect() == []
    assert S.search(none, no_items).collect() == []


def test_ties_across_many_tasks(spark):
    docs = [(i, "same words here" if i % 3 else "same words here now") for i in range(1000)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], SCHEMA).repartition(13)
    items = [(1, "words"), (2, "now here")]
    assert rows(S.search(df, spark.createDataFrame(items, ITEM_SCHEMA))) == brute(docs, items)


def test_text_longer_than_a_block(spark):
    docs = [(1, "needle " + "hay stack " * 150_000), (2, "needle hay"), (3, "stack")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], SCHEMA)
    items = [(1, "needle in a hay stack")]
    assert rows(S.search(df, spark.createDataFrame(items, ITEM_SCHEMA))) == brute(docs, items)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(S.search(docs, items)) == want


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    """All words of one length share a hash: the lookup must still find each its own term."""
    from tokenledger.llm.textblocks import Block
    monkeypatch.setattr(Block, "word_hashes", lambda b: (b.ends - b.starts).astype(np.uint64))

    class Rows:
        def select(self, *_):
            return self

        def toArrow(self):
            return pa.table({"item": pa.array([0, 0, 1, 1], pa.int64()), "term": pa.array([b"aa", b"bb", b"bb", b"ccc"], pa.binary()),
                             "count": pa.array([1, 2, 3, 4], pa.int64())})

    index = S.build_index(Rows())
    for b in blocks(pa.array(["bb aa zz ccc ddd aa"]), IS_WORD, lower=True):
        word, term = S.look_up(b, index)
        got = sorted((int(w), index.data[index.bounds[t]:index.bounds[t + 1]].tobytes()) for w, t in zip(word, term))
    assert got == [(0, b"bb"), (1, b"aa"), (3, b"ccc"), (5, b"aa")]
