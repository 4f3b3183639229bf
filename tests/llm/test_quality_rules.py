"""Base counts against plain Python, the cascade's order against its results."""

from collections import Counter

from tests.llm.cases import SCHEMA, SPACE_WORD, clashing, edge_docs
from tokenledger.llm import quality_rules as Q
from tokenledger.llm.samples import some_texts


def brute(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:]))
    n, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(inside), failed)


def check(df):
    got = sorted((tuple(r)[:7] for r in Q.quality_cascade(df).collect()), key=repr)
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in df.select("doc_id", "text").collect()), key=repr)
    assert got == want


def test_base_counts(spark):
    check(edge_docs(spark))
    check(clashing(edge_docs(spark)))
    check(spark.createDataFrame([], SCHEMA))
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_the_order_changes_no_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = list(Q.RULES)
    a = Q.quality_cascade(docs, names)
    assert a.exceptAll(Q.quality_cascade(docs, names[::-1])).count() == 0
    assert sorted(Q.rule_order(some_texts(docs, 100))) == sorted(names)
    assert a.filter("base_failed and kept").count() == 0


def test_kept_agrees_with_labels(spark):
    d = "/root/testdata/sf0.1"
    got = Q.quality_cascade(spark.read.parquet(f"{d}/documents.parquet")).filter("not base_failed")
    t = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in t}
    assert n.get((1, False), 0) == 0                      # clean documents stay
    assert n.get((0, False), 0) > 0.95 * (n.get((0, False), 0) + n.get((0, True), 0))
