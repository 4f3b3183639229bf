"""SimHash groups against all pairs by brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.cases import SCHEMA, SPACE_WORD, ascii_lower, clashing, edge_docs
from tokenledger.llm import components as C
from tokenledger.llm import simhash as S
from tokenledger.llm.xxh64 import hash_ranges


def fingerprint(text):
    words = SPACE_WORD.findall(ascii_lower(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def groups(fps, distance=3):
    """Smallest fingerprint of each one's component, over all pairs."""
    f = np.array(sorted(set(fps)), np.uint64)
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= distance) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    return {int(f[i]): int(f[find(i)]) for i in range(len(f))}


def check(docs):
    data = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r["text"]) for r in data]
    root, low = groups(fps), {}
    for r, f in zip(data, fps):
        if r["doc_id"] is not None:
            low[root[f]] = min(low.get(root[f], r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{f:016x}", low.get(root[f])) for r, f in zip(data, fps)), key=repr)
    assert sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=repr) == want


def test_hashes_of_all_lengths():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    starts = rng.integers(0, 18_000, 20_000)
    ends = starts + rng.integers(0, 140, 20_000)
    ends[:3] = 20_000
    want = [xxhash.xxh64_intdigest(data[s:e].tobytes(), 42) for s, e in zip(starts, ends)]
    assert hash_ranges(data, starts, ends).tolist() == want


def test_edge_documents(spark):
    check(edge_docs(spark))
    check(clashing(edge_docs(spark)))
    check(spark.createDataFrame([], SCHEMA))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def clustered(rng, n):
    """Fingerprints in chains and balls, some sharing a whole half."""
    half = rng.getrandbits(32)
    out = [rng.getrandbits(64) for _ in range(n // 4)] + [rng.getrandbits(32) << 32 | half for _ in range(n // 4)]
    for _ in range(n // 2):
        f = rng.choice(out)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            f ^= 1 << b
        out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 3}, {"parts": 3, "bucket_rows": 5}, {"parts": 4, "bucket_rows": 1},
                                     {"distance": 2, "parts": 2, "bucket_rows": 4}, {"distance": 5, "parts": 4}])
def test_links_connect_what_all_pairs_connect(spark, options):
    fps = clustered(random.Random(repr(options)), 600)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = S.links(df, **options)
    got = {}
    for r in C.components(edges, "u", "v").collect():
        got[r["node"] % (1 << 64)] = r["root"]
    distance = options.get("distance", 3)
    assert all((int(e["u"]) ^ int(e["v"])).bit_count() <= distance
               for e in [{k: e[k] % (1 << 64) for k in ("u", "v")} for e in edges.collect()])
    mine, want = {}, {}
    for f, root in groups(fps, distance).items():
        want.setdefault(root, set()).add(f)
        mine.setdefault(got.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_thresholds_keep_the_pigeonhole_sum_and_follow_the_work():
    f = np.full(64, 0.5)
    parts = [list(range(32)), list(range(32, 64))]
    assert S.thresholds(parts, 3, 100_000, f) == [1, 1]
    f[:32] = 0.001                                       # a half that tells little is left out
    assert sum(S.thresholds(parts, 3, 100_000, f)) == 2 and S.thresholds(parts, 3, 100_000, f)[0] < 1
    assert sum(S.thresholds([list(range(i, i + 16)) for i in range(0, 64, 16)], 3, 1000, f)) == 0


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (5000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 50] = bits[:, 3]
    part = next(p for p in S.group_bits(list(range(64)), 2, 5000, (bits.T @ bits).astype(float)) if 3 in p)
    assert {3, 40, 50} <= set(part) and len(part) == 32


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 2001)] * 2
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == ({i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000, 2001: 2000})
    assert C.components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_word_rule():
    assert re.fullmatch("[0-9a-f]{16}", f"{fingerprint('A b'):016x}") and fingerprint(" ") == 0


def test_keep_one_of_repeated_rows_and_equal_ids(spark):
    from pyspark.sql import functions as F
    text = "alpha beta gamma delta epsilon zeta"
    data = [(1, text, "en", "a", 1)] * 500 + [(1, text, "en", "b", 1)] * 2 + [(2, text, "en", "a", 1), (None, text, None, None, 1)]
    data += [(7, "quite other words stand in this one", "en", "a", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = S.keep_one(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == [(False, 1), (False, 7), (True, None)]
    assert all(tuple(r) in set(data) for r in out)
    wide = df.withColumn("key", F.lit("x")).withColumn("wins", F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2))))
    assert [r["doc_id"] for r in S.keep_one(wide).collect()].count(1) == 1
