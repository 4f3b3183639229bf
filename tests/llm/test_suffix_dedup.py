"""Removed bytes against all windows by brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, clashing, edge_docs, rows
from tokenledger.llm import suffix_dedup as S


def brute(docs, width=50):
    lowest = {}
    for i, t in docs:
        b, key = (t or "").encode(), 2**63 - 1 if i is None else i
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            lowest[w] = min(lowest.get(w, key), key)
    out = []
    for i, t in docs:
        b, key = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if lowest[b[p:p + width]] < key:
                gone[p:p + width] = b"\1" * width
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(df, width=50, **options):
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], width)
    got = rows(S.remove_repeated(df, width, **options))
    assert got == want
    return want


def test_edge_documents(spark):
    check(edge_docs(spark))
    check(clashing(edge_docs(spark)))
    check(spark.createDataFrame([], SCHEMA))
    check(spark.createDataFrame([(1, "short", "en", "a", 5), (None, None, None, None, None)], SCHEMA))


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_shared_passages(spark, block_bytes):
    rng = random.Random(block_bytes)
    passages = ["".join(rng.choices("ab é\n", k=rng.choice([20, 49, 50, 51, 70, 200]))) for _ in range(12)]
    docs = []
    for i in range(120):
        t = "".join(rng.choices("abcdefgh", k=rng.randrange(40)))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            t += p[rng.randrange(3):len(p) - rng.randrange(3)] + "".join(rng.choices("xyz", k=rng.randrange(30)))
        if rng.random() < 0.1:
            t += "-" * rng.randrange(200)                     # long runs of one byte
        docs.append((rng.choice([i, i, i // 2, None]), t, "en", "s", 0))
    want = check(spark.createDataFrame(docs, SCHEMA).repartition(5), buckets=7, block_bytes=block_bytes)
    assert sum(r[2] > 0 for r in want) > 30 and any(r[3] > 1 for r in want)


def test_a_hot_gram_is_split_over_the_buckets(spark):
    rng = random.Random(3)
    passage = "a passage that very many documents share, each between bytes of its own"
    own = ["".join(rng.choices("abcdefgh", k=80)) for _ in range(600)]
    docs = [(i // 2, (own[i - 1] if i % 9 == 0 else own[i])[:60] + passage + own[i][60:], "en", "s", 0) for i in range(600)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    packed = S.pack_blocks(df, 4000)
    largest = [max(r["n"] for r in S.run_entries(packed, 50, 64, hot).groupBy("bucket").agg(
        F.sum(F.length("data") / 22).alias("n")).collect()) for hot in (S._NONE, S.hot_grams(packed, 50, 100))]
    assert largest[0] > 500 and largest[1] < 200
    want = check(df, buckets=64, block_bytes=4000, hot_entries=100)
    assert sum(r[2] > 0 for r in want) > 500


@pytest.mark.parametrize("counters", [S.COUNTERS, 64])
def test_a_gram_that_stands_once_a_block_is_found(spark, counters, monkeypatch):
    rng = random.Random(4)
    passage = "one passage that four hundred documents share, one document in each block"
    docs = [(i, "".join(rng.choices("abcdefgh", k=60)) + passage + "".join(rng.choices("abcdefgh", k=60)), "en", "s", 0)
            for i in range(400)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    packed = S.pack_blocks(df, 1)
    assert packed.count() == 400
    hot = S.hot_grams(packed, 50, 100, counters)                 # a task's few thousand entries cost some dozens of a count
    largest = [max(r["n"] for r in S.run_entries(packed, 50, 64, h).groupBy("bucket").agg(
        F.sum(F.length("data") / 22).alias("n")).collect()) for h in (S._NONE, hot)]
    assert 0 < len(hot) < 60 and largest[0] > 400 > 250 > largest[1]
    check(df, buckets=64, block_bytes=1, hot_entries=100)


def most(entries, n_bytes, before):
    """The most entries of one string; its hash follows ``before`` bytes an entry in a row's data."""
    n = Counter()
    for r in entries.collect():
        parts = len(r["data"]) // n_bytes
        at = before * parts
        n.update((r["bucket"], r["data"][at + 8 * i:at + 8 * i + 8]) for i in range(parts))
    return max(n.values())


@pytest.mark.parametrize("ids", ["own", "third without"])
def test_hot_runs_and_windows_stay_in_their_blocks(spark, ids):
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefghijklmnop ", k=300))                # its inner runs are equal everywhere
    own = ["".join(rng.choices("qrstuvwxyz", k=60)) for _ in range(300)]
    docs = [(None if ids != "own" and i % 3 == 0 else i, o[:30] + passage + o[30:], "en", "s", 0) for i, o in enumerate(own)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    packed = S.pack_blocks(df, 1)
    hot = S.hot_grams(packed, 50, 100)
    shared = S.shared_runs(packed, 50, hot, 100)
    assert len(shared.hashes) and set(shared.low.tolist()) <= {0, 1}
    before, after = (most(S.run_entries(packed, 50, 16, hot, s), 22, 4) for s in (S.NOTHING, shared))
    assert before == 300 and after < 100
    answers = S._collected(S._sort_buckets(S.run_entries(packed, 50, 16, hot, shared), S._answer_runs), "runs")
    first = packed.join(answers, "block", "left").cache()
    same = S.shared_windows(first, 50, 16, hot, shared, 100)
    before, after = (most(S.window_entries(first, 50, 16, hot, shared, s), 16, 0) for s in (S.NOTHING, same))
    first.unpersist()
    assert len(same.hashes) and before > 250 and after < 100
    want = check(df, buckets=16, block_bytes=1, hot_entries=100)
    assert sum(r[2] >= 300 for r in want) >= 299


def test_counters_fall_short_by_their_share_at_most():
    rng = random.Random(6)
    grams = [rng.choice([1, 2, 3, rng.randrange(10**6)]) for _ in range(20_000)]
    have = S._NONE, S._NONE.astype("int64")
    for i in range(0, len(grams), 1000):
        part = S.np.unique(S.np.array(grams[i:i + 1000], S.np.uint64), return_counts=True)
        have = S._add_up([have[0], part[0]], [have[1], part[1]], 100)
    found = dict(zip(have[0].tolist(), have[1].tolist()))
    assert len(found) <= 100 and all(grams.count(g) - 200 <= found[g] <= grams.count(g) for g in (1, 2, 3))


def test_buckets_follow_the_text(spark, monkeypatch):
    packed = S.pack_blocks(edge_docs(spark))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S._n_buckets(packed) == parts
    monkeypatch.setattr(S, "BUCKET_BYTES", 100)
    assert S._n_buckets(packed) > max(parts, 1000)
    assert S._n_buckets(S.pack_blocks(spark.createDataFrame([], SCHEMA))) == parts


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
