"""The two classifiers: held-out accuracy, inputs, and edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import SCHEMA, clashing, edge_docs, rows
from tokenledger.llm import quality_fm as Q
from tokenledger.llm import toxicity as X

D = "/root/testdata/sf0.1"
RUN = {"quality": Q.quality, "toxic": X.toxicity}


def tables(spark, d=D):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_accuracy(spark, label):
    docs, labels = tables(spark)
    out = RUN[label](docs, labels)
    got = out.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", label).collect()
    assert out.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    ok = sum(r["predicted"] == r[label] for r in held)
    found = [r["predicted"] for r in held if r[label] == 1]
    clean = [r["predicted"] for r in held if r[label] == 0]
    assert ok >= 0.975 * len(held) and np.mean(found) > 0.9 and np.mean(clean) < 0.08
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_edge_documents_and_inputs(spark, label):
    _, labels = tables(spark, "/root/testdata/sf0.01")
    docs, _ = tables(spark, "/root/testdata/sf0.01")
    edge = edge_docs(spark)
    a = rows(RUN[label](docs.unionByName(edge), labels).drop("spans").filter("doc_id is null or doc_id < 20"))
    assert len(a) == len(edge.collect()) + docs.filter("doc_id < 20").count()
    assert all(r[1] is False for r in a if r[0] is None)
    assert rows(RUN[label](clashing(edge), labels).drop("spans")) == rows(RUN[label](edge, labels).drop("spans"))
    assert RUN[label](spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = RUN[label](edge, labels.limit(0)).collect()                       # no labels: one constant score
    assert {r["score"] for r in none} == {0.0}


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F
    docs, labels = tables(spark, "/root/testdata/sf0.01")
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                              1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(X.toxicity(docs, wrong).drop("spans")) == rows(X.toxicity(docs, labels).drop("spans"))


def test_pairwise_sum_in_linear_time_equals_all_pairs():
    rng = np.random.default_rng(2)
    v, w, x = rng.normal(size=(30, 4)), rng.normal(size=30), rng.normal(size=12)
    index = rng.choice(30, 12, replace=False)
    z = Q.margin(Q.Model(0.3, w, v, []), np.zeros(12, int), index, x, 1)[0]
    pairs = sum(v[index[i]] @ v[index[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    assert z == pytest.approx(0.3 + w[index] @ x + pairs)


def test_chain_marginals_equal_sums_over_all_paths(monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 4)
    rng = np.random.default_rng(1)
    scores, trans, start = rng.normal(size=19), rng.normal(size=(2, 2)), 0.4
    bounds = np.array([0, 0, 1, 9, 9, 19])
    p, _, _ = X.chain(scores, bounds, start, trans)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        n = hi - lo
        weight = np.zeros(2 ** n)
        for path in range(2 ** n):
            y = [path >> i & 1 for i in range(n)]
            weight[path] = np.exp(sum(scores[lo + i] * y[i] for i in range(n)) + (start * y[0] if n else 0)
                                  + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
        for i in range(n):
            assert X.chain_in_parts(scores, bounds, start, trans, 3)[0][lo + i] == pytest.approx(p[lo + i])
            on = sum(weight[path] for path in range(2 ** n) if path >> i & 1)
            assert p[lo + i] == pytest.approx(on / weight.sum())


def test_spans_point_at_the_offending_words(spark):
    docs, labels = tables(spark)
    model = X.train(docs, labels)
    text = "Été the of and with, idiot scum! the of and the thand worthless."
    out = X.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    raw = text.encode()
    words = [raw[s["start"]:s["end"]].decode() for s in out["spans"]]
    assert any("idiot" in w for w in words) and not any("Été" in w or "thand" in w for w in words)


def test_fit_without_a_class():
    assert X.fit(pa.array(["a"]), np.array([1]), {1: 3}).constant == 1.0
    assert Q.fit(pa.array(["a"]), np.array([1.0]), np.array([0]), {0: 2}).constant == 0.0


def test_a_repeated_labelled_id_does_not_crowd_out_a_class(spark):
    """One low id with thousands of rows, and long texts among the labelled: both classes stay in the sample."""
    from pyspark.sql import functions as F
    from tokenledger.llm.samples import labelled_sample
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(i, f"text of {i} " * (1 if i % 3 else 3000), "en", "a", 5) for i in train]
    df = spark.createDataFrame(docs, SCHEMA).unionByName(spark.createDataFrame(docs[:1], SCHEMA).withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.lit(4500)))).withColumn("text", F.concat(F.lit("copy "), "n")).drop("n"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in train] + [(train[0], 1, 1)], "doc_id long, quality int, toxic int")
    sample, sizes = labelled_sample(df, labels, "toxic", 60, 16_384)
    texts, got = sample.column("text").to_pylist(), sample.column("label").to_pylist()
    assert got.count(0) == got.count(1) == 60 and max(map(len, texts)) <= 16_384
    assert sum(t.startswith("copy") or t == f"text of {train[0]} " for t in texts) <= 1
    assert sizes[1] + sizes[0] == len(train) + 1
