"""Mixing against a plain sequential model."""

import hashlib
from collections import defaultdict
from fractions import Fraction

from tests.llm.cases import SCHEMA, SPACE_WORD, clashing, edge_docs, rows
from tokenledger.llm import mixing


def targets(sizes):
    """Share, cap at three sizes, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, free = {}, set(names)
    while free:
        rest = sum(sizes.values()) - sum(capped.values())
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: float(x) for s, x in (capped | share).items()}
        capped |= {s: Fraction(3 * sizes[s]) for s in over}
        free -= over
    return {s: float(x) for s, x in capped.items()}


def brute(docs):
    by = defaultdict(list)
    for r in docs:
        by[r["source"]].append((r["doc_id"], len(SPACE_WORD.findall(r["text"] or ""))))
    sizes = {s: sum(n for _, n in v) for s, v in by.items()}
    out, t = [], targets(sizes)
    for s, v in by.items():
        budget = int(t[s] + 0.5)
        whole = budget // sizes[s] if sizes[s] else 0
        rest, groups = budget - whole * sizes[s], defaultdict(int)
        for i, n in v:
            groups[(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, n)] += 1
        for (_, known, i, n), copies in sorted(groups.items()):
            give = min(max(rest, 0), n * copies) // copies
            rest -= n * copies
            out += [(i if known else None, n, sizes[s], t[s], whole * n + give)] * copies
    return sorted(out, key=repr)


def check(df):
    got = mixing.mix_sources(df).select("doc_id", "size", "source_size", "target", "taken")
    want = brute(df.select("doc_id", "source", "text").collect())
    assert [(*r[:3], round(r[3], 6), r[4]) for r in rows(got)] == [(*r[:3], round(r[3], 6), r[4]) for r in want]
    return want


def test_edge_documents(spark):
    check(edge_docs(spark))
    check(clashing(edge_docs(spark)))
    check(spark.createDataFrame([], SCHEMA))
    check(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], SCHEMA))


def test_whole_table_and_small_ranges(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = check(docs)
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 20)         # many ranges: the same cut
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert check(docs) == a
    by = defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        by[r["source"], r["target"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken - target) <= 1 for (_, target), taken in by.items())


def test_one_source_and_one_hot_id(spark):
    data = [(i % 3, "w " * (i % 7), "en", "s" if i % 4 else "t", 0) for i in range(400)]
    check(spark.createDataFrame(data, SCHEMA))
