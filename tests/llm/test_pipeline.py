"""Every pipeline stage against a brute-force version of its decision, on its own input."""

import pytest

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_mixing, test_simhash
from tests.llm.cases import SCHEMA, clashing, edge_docs, rows
from tokenledger.llm import toxicity as X

D = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for _, step in P.STAGES:
        got = P.stage(step(spark, docs, D), "test-pipeline")
        out.append((docs, got))
        docs = got
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stage_contract(outputs):
    assert 4 <= len(P.STAGES) <= 5 and [n for n, _ in P.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "secrets", "mix"]
    for before, after in outputs[:-1]:
        assert after.columns == before.columns == COLUMNS and after.schema == before.schema


def test_toxic_documents_go(spark, outputs):
    before, after = outputs[0]
    scored = X.toxicity(before, spark.read.parquet(f"{D}/labels.parquet")).filter("predicted = 0")
    assert rows(after) == rows(before.join(scored.select("doc_id"), "doc_id").select(*COLUMNS))


def test_one_document_of_each_group_stays(outputs):
    before, after = outputs[1]
    data = before.collect()
    fps = [test_simhash.fingerprint(r["text"]) for r in data]
    root, low = test_simhash.groups(fps), {}
    for r, f in zip(data, fps):
        low[root[f]] = min(low.get(root[f], r["doc_id"]), r["doc_id"])
    assert rows(after) == sorted((tuple(r) for r in data if r["doc_id"] in set(low.values())), key=repr)


def test_contaminated_documents_go(spark, outputs):
    before, after = outputs[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    words = {w for _, t in items for w in test_decontaminate.words(t)}
    data = [(r["doc_id"], r["text"]) for r in before.collect()]
    likely = [d for d in data if len(words & set(test_decontaminate.words(d[1]))) > 5]
    bad = {r[0] for r in test_decontaminate.brute(likely, items) if r[5]}
    assert bad and ids(after) == {d[0] for d in data} - bad


def test_secrets_are_masked_and_all_stay(outputs):
    before, after = outputs[3]
    assert ids(after) == ids(before) and before.filter("text like '%[SECRET]%'").count() == 0
    assert after.filter("text like '%[SECRET]%'").count() > 0
    changed = after.exceptAll(before)
    assert changed.filter("text not like '%[SECRET]%'").count() == 0


def test_mix_takes_what_the_sequential_model_takes(outputs):
    before, after = outputs[4]
    want = [r for r in test_mixing.brute(before.collect()) if r[4] > 0]
    got = rows(after.select("doc_id", "size", "source_size", "target", "taken"))
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]


def test_run_equals_its_stages(spark, outputs):
    assert rows(P.run(spark, D)) == rows(outputs[-1][1])


@pytest.mark.parametrize("make", [edge_docs, lambda s: clashing(edge_docs(s)), lambda s: s.createDataFrame([], SCHEMA)])
def test_edge_documents_pass_every_stage(spark, make):
    docs = make(spark)
    for name, step in P.STAGES:
        out = P.stage(step(spark, docs, D), "test-edges")
        if name != "mix":
            assert set(out.columns) == set(docs.columns)
        if name in ("toxicity", "secrets"):
            assert out.count() == docs.count()              # none of the edge documents is toxic
        if name == "near_duplicates":
            n = out.count()
            assert n == len({test_simhash.groups([test_simhash.fingerprint(r["text"]) for r in docs.collect()])[f]
                             for f in [test_simhash.fingerprint(r["text"]) for r in docs.collect()]})
        docs = out
