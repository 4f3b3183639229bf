"""Token counts against the library's own encoding of whole texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import SCHEMA, clashing, edge_docs
from tokenledger.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df):
    want = {}
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])
           for r in tokens.token_counts(df, PATH).collect()]
    data = df.select("doc_id", "text").collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n, n > 1024)
            for r, n in zip(data, library([r["text"] for r in data]))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edge_documents(spark):
    check(edge_docs(spark))
    check(clashing(edge_docs(spark)))
    check(spark.createDataFrame([], SCHEMA))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_a_small_table_and_cache_give_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = tokens.token_counts(docs, PATH, sample_docs=1, table_size=3)
    b = tokens.token_counts(docs, PATH)
    assert a.exceptAll(b).count() == 0 and a.agg(F.sum("n_tokens")).first()[0] > 0


def test_long_pretokens_are_counted_and_not_kept(spark):
    texts = [("word " * 300_000 + "y" * 100_000), "z" * 65 + " " + "z" * 64]
    with open(PATH, encoding="utf-8") as f:
        counter = tokens.Counter2(f.read(), {})
    assert [counter.count(t) for t in texts] == library(texts)
    assert "z" * 65 not in counter.lengths and max(map(len, counter.lengths)) <= 64
    assert max(map(len, tokens.frequent_lengths(texts, counter.tokenizer.to_str()))) <= 64


@pytest.mark.parametrize("low, high", [(0, 0x80), (0x80, 0x250), (0x250, 0x3000)])
def test_every_character_splits_as_the_library_splits_it(low, high):
    with open(PATH, encoding="utf-8") as f:
        counter = tokens.Counter2(f.read(), {})
    texts = []
    for c in map(chr, range(low, high)):
        texts += [f"a{c}b", f" {c}", f"{c}{c} {c}1{c}", f"1{c}\n{c}  {c}", f"!{c}!{c}a  ", f"'{c}'s{c}'ll"]
    assert [counter.count(t) for t in texts] == library(texts)
