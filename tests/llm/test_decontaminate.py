"""Winnowing against all windows by brute force."""

import hashlib
import random

from tests.llm.cases import ALNUM_WORD, SCHEMA, ascii_lower, clashing, edge_docs, rows
from tokenledger.llm import decontaminate as D


def words(text):
    return ALNUM_WORD.findall(ascii_lower(text))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            iw = words(t)
            n = min(13, len(iw))
            if not n:
                continue
            spans = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in spans:
                    hit.update(range(p, p + n))
                    ids.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(docs, bench):
    got = rows(D.decontaminate(docs, bench))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got == want
    return want


def test_random_texts_with_short_and_repeated_items(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["É", "中"]
    items = [(i if i % 9 else None, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))))
             for i in range(40)]
    items += [(100 + i, items[7][1]) for i in range(5)] + [(7, "same id again"), (200, None)]
    docs = []
    for i in range(150):
        t = rng.choices(vocab, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            s = (items[rng.randrange(len(items))][1] or "").split()
            p = rng.randrange(len(t) + 1)
            t[p:p] = s[rng.randrange(3):]
        docs.append((i, " ".join(t).upper() if i % 2 else ", ".join(t), "en", "s", 0))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, SCHEMA)
    a = check(d, b)
    assert sum(r[2] > 0 for r in a) > 20
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BITMAP_BITS", 64)              # a full bitmap only lets more rows through
    check(d, b)


def test_edge_documents(spark):
    b = spark.createDataFrame([(1, "beta gamma"), (2, "Word " * 13), (None, "x"), (3, "")], "item_id long, text string")
    check(edge_docs(spark), b)
    check(clashing(edge_docs(spark)).drop("x"), b.withColumn("class", b.text))
    check(edge_docs(spark), b.limit(0))
    check(spark.createDataFrame([], SCHEMA), b)


def test_a_passage_of_many_items_costs_a_row_a_window(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"d{i} x {passage} y e{i}", "en", "s", 0) for i in range(40)], SCHEMA)
    joined = []
    for n in (1, 30):
        b = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(n)], "item_id long, text string")
        joined.append(D.find_overlaps(docs, b)[1].count())
        assert all(r[2] == 20 and r[3] == n for r in check(docs, b))
    assert joined == [40 * 8, 40 * 8]


def test_a_text_of_several_blocks(spark):
    span = " ".join(f"s{i}" for i in range(13))
    text = "Filler word " * 150_000 + span + " and on" * 100_000
    d = spark.createDataFrame([(1, text, "en", "s", 0), (2, span, "en", "s", 0)], SCHEMA)
    got = rows(D.decontaminate(d, spark.createDataFrame([(5, f"q {span} r")], "item_id long, text string")))
    assert [(r[0], r[1], r[2], r[3], r[5]) for r in got] == [(1, 500_013, 13, 1, False), (2, 13, 13, 1, True)]
