"""Whitening against a dense eigendecomposition in plain numpy and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tokenledger.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def usable(data):
    keep = [(i, [math.floor(256 * c) for c in map(float, v)]) for i, v in data
            if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(x) for _, x in keep]
    d = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    return [(i, x) for i, x in keep if len(x) == d]


def check(df, data, components=4):
    keep = usable(data)
    fit = sorted({tuple(x) for _, x in keep})
    n, out = len(fit), W.whiten(df, components).collect()
    if n < 2:
        assert out == []
        return out
    sums = [sum(c) for c in zip(*fit)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    by = {}
    for r in out:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9
    assert sorted(by) == list(range(1, k + 1))
    want_dev = sorted(((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in keep), key=repr)
    dense = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in keep])
    for c, found in by.items():
        assert sorted(((r["vec_id"], r["deviation"]) for r in found), key=repr) == want_dev
        assert abs(found[0]["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
        w = dense @ axes[:, c - 1] / np.sqrt(values[c - 1])
        want = sorted(((i, x) for (i, _), x in zip(keep, w.tolist())), key=repr)
        got = {}
        for r in found:
            got.setdefault((r["vec_id"], r["deviation"]), []).append(r["whitened"])
        apart = [abs(values[c - 1] - v) for i, v in enumerate(values) if i != c - 1]
        if min(apart) > 1e-6 * values[0]:
            a = np.sort([x for _, x in want])
            b = np.sort([r["whitened"] for r in found])
            assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-8
    return out


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(df, [(r["vec_id"], r["embedding"]) for r in df.collect()])


EDGES = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]),
         (6, [0.5, -0.25, 3.0]), (6, [0.5, -0.25, 3.0]), (None, [0.1, 0.2, 0.3]), (7, [-0.0, 0.0, 1.0]), (8, [0.0, -0.0, 1.0]),
         (9, [1.0, 2.0]), (10, [100.0, -7.5, 0.001]), (11, [5.0, 5.0, 5.0]), (12, [-1e-9, 1e-9, 0.0])]


def test_edge_rows(spark):
    df = spark.createDataFrame(EDGES, SCHEMA)
    out = check(df.repartition(3), EDGES)
    assert {r["component"] for r in out} == {1, 2, 3}
    from pyspark.sql import functions as F
    wide = df
    for c in ("x", "n", "component", "deviation", "whitened", "d", "dim", "label"):
        wide = wide.withColumn(c, F.lit("x"))
    assert len(check(wide, EDGES)) == len(out)
    check(spark.createDataFrame([], SCHEMA), [])
    check(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], SCHEMA), [(1, [0.5, 2.0])])


def test_dominant_copies_count_once(spark):
    data = [(i, [0.25, 1.0, -3.0]) for i in range(900)] + [(i, [i / 7, (i % 5) / 3, -i / 11]) for i in range(900, 1000)]
    check(spark.createDataFrame(data, SCHEMA).repartition(5), [(i, list(map(np.float32, v))) for i, v in data])


def test_rank_and_repeated_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    for values in ([9, 9, 9, 4, 4, 1e-6, 0, 0, 0, 0, 0, 0], [1e8, 1, 1e-3, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0] * 12):
        c = (q * np.array(values)) @ q.T
        got, axes = W.one_sided_jacobi(W.pivoted_cholesky((c + c.T) / 2))
        want = np.array([v for v in values if v], float)
        assert np.allclose(got[:len(want)], want, rtol=1e-5) and np.allclose(got[len(want):], 0, atol=1e-6 * max(values))
        assert np.allclose(axes.T @ axes, np.eye(len(got)), atol=1e-10)


@pytest.mark.parametrize("top", [1000, 1 << 50, (1 << 63) - 1])
def test_deviations_are_exact_or_null(top):
    x = np.array([[top, -top, 3], [1, 2, 3]], np.int64)
    n, sums = 7, [5 * top, -2, 40]
    want = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x.tolist()]
    assert W.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    assert W._exact_sums(x) == [sum(c) for c in zip(*x.tolist())]
