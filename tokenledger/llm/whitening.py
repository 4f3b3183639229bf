"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

An embedding's entries become integers, ``floor(scale * entry)``. The fit list is
each distinct integer vector once; Spark finds it with a distinct (copies are
combined before they are shuffled) and sums it per dimension exactly. A second pass
adds up the scatter of the centred vectors, one d x d matrix a task, combined in
Spark. On the driver the d x d scatter, whatever the number of rows, is factored by
Cholesky with diagonal pivoting, P'CP = LL', and the columns of the triangular
factor L are rotated in pairs until they are orthogonal (one-sided Jacobi): the
squared column norms are the eigenvalues of C, the normalised columns its
eigenvectors, small ones as relatively accurate as large ones.

Defined cases: rows whose vector is null or empty, or holds a null or non-finite
entry, are dropped; so are vectors whose length differs from the most frequent one
(of equally frequent lengths the smaller counts), for they have no covariance with
the rest. Entries beyond a long after scaling are cut to its range. Repeated rows and
null ids give rows of their own; other columns are not read, whatever their names. A
``deviation`` beyond a long is null. Components whose eigenvalue is zero to rounding
do not exist: a fit list of r + 1 independent vectors has r components, an empty or
constant table none, and then the result has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage

SCALE = 256
COMPONENTS = 4
#: rows of a batch that are worked on at a time
ROWS = 4096
_LONG = 1 << 63


@dataclass
class Whitening:
    """n: vectors of the fit list; sums: their exact sums per dimension; values, axes: eigenvalues of the covariance,
    falling, and unit eigenvectors as columns; trace: of the covariance; identity_error: largest absolute entry of
    the whitened fit list's covariance minus the identity."""
    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0


def integer_vectors(embeddings: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of long) of the rows that can be used."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # + 0 as a long: a negative zero is zero
    x = F.transform(values, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(0).cast("long"))
    usable = embeddings.select("vec_id", F.col(vector)).filter(
        F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    return usable.select("vec_id", x.alias("x"))


def _matrix(column: pa.ListArray, lo: int, hi: int, d: int) -> np.ndarray:
    """Rows lo .. hi - 1 of an Arrow list column, all of length d."""
    return column.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _tiles(batches: Iterator[pa.RecordBatch], d: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            hi = min(lo + ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo), _matrix(batch.column(at), lo, hi, d)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    if len(x) and max(int(x.max()), -int(x.min())) < (1 << 62) // len(x):
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def fit_size(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal
        n, sums = 0, [0] * d
        for _, x in _tiles(batches, d):
            n += len(x)
            sums = [a + b for a, b in zip(sums, _exact_sums(x))]
        if n:
            total = pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int32()), total], ["dim", "total"])

    rows = (fit.mapInArrow(part, "dim int, total decimal(38,0)").groupBy("dim")
            .agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect())              # d + 1 rows
    total = {r["dim"]: int(r["total"]) for r in rows}
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles; S/n split into whole part and rest, so that large means cost no digits."""
    whole = np.array([s // n for s in sums], np.float64)
    rest = np.array([(s % n) / n for s in sums])
    small = np.abs(whole).max(initial=0.0) < 2.0 ** 52 and np.abs(x).max(initial=0) < 1 << 52
    if small:
        return (x - whole.astype(np.int64)) - rest
    return (x.astype(np.float64) - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)**2, exact; None beyond a long."""
    if not len(x):
        return []
    top = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if top * top * x.shape[1] < _LONG:
        z = np.int64(n) * x - np.array(sums, np.int64)
        return (z * z).sum(axis=1).tolist()
    out: list[int | None] = []
    for row in x.tolist():
        total = sum((n * v - s) ** 2 for v, s in zip(row, sums))
        out.append(total if total < _LONG else None)
    return out


def scatter(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Sum of z z' over the centred fit list."""
    i, j = np.triu_indices(d)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((d, d)), 0
        for _, x in _tiles(batches, d):
            z = centred(x, n, sums)
            total += z.T @ z
            rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             ["i", "j", "v"])

    cells = fit.mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))                                                                    # d * (d + 1) / 2 cells
    a, b, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out[a, b] = v
    out[b, a] = v
    return out


def pivoted_cholesky(c: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """L of c = LL' with d rows (in c's order) and as many columns as the rank; each column takes the largest
    remaining diagonal entry, down to ``tolerance`` of the largest of all."""
    c = c.copy()
    d = len(c)
    columns = []
    first = float(c.diagonal().max(initial=0.0))
    left = np.ones(d, bool)
    for _ in range(d):
        p = int(np.argmax(np.where(left, c.diagonal(), -1.0)))
        if not left[p] or c[p, p] <= tolerance * first:
            break
        column = np.where(left, c[:, p], 0.0) / np.sqrt(c[p, p])
        columns.append(column)
        c -= np.outer(column, column)
        left[p] = False
    return np.array(columns).T if columns else np.zeros((d, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of LL', falling: L's columns rotated until orthogonal."""
    a = factor.copy()
    r = a.shape[1]
    eps = np.finfo(float).eps * max(1, len(a)) ** 0.5
    for _ in range(sweeps):
        turned = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                x, y = a[:, p], a[:, q]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= eps * np.sqrt(xx * yy):
                    continue
                turned = True
                zeta = (yy - xx) / (2 * xy)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                a[:, p], a[:, q] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    norms = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    axes = a[:, order] / norms[order]
    # either sign is right; the entry of largest size is positive
    top = np.abs(axes).argmax(axis=0) if axes.size else np.zeros(0, int)
    return norms[order] ** 2, axes * np.sign(axes[top, np.arange(axes.shape[1])])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from a pass over the list."""
    d, k = model.axes.shape
    if not k:
        return 0.0
    project = model.axes / np.sqrt(model.values)
    n, sums = model.n, model.sums

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _tiles(batches, d):
            w = centred(x, n, sums) @ project
            total += w.T @ w
        at = np.arange(k * k, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    cells = fit.mapInArrow(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()    # k * k rows
    cov = np.zeros(k * k)
    for r in cells:
        cov[r["at"]] = r["v"] / n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The model of a fit list (x: distinct integer vectors of length d)."""
    n, sums = fit_size(fit, d)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    c = scatter(fit, d, n, sums)
    values, axes = one_sided_jacobi(pivoted_cholesky(c))
    model = Whitening(n, sums, values[:components] / n, axes[:, :components], float(np.trace(c)) / n)
    model.identity_error = identity_error(fit, model)
    return model


def project(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of ``vectors``
    (x, vec_id) and component."""
    d, k = model.axes.shape
    shared = vectors.sparkSession.sparkContext.broadcast(model)        # d x components doubles
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        axes = m.axes / np.sqrt(m.values)
        for part, x in _tiles(batches, d):
            w = centred(x, m.n, m.sums) @ axes
            again = pa.array(np.repeat(np.arange(len(x)), k))
            rows = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [part.column(1).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(rows, m.n, np.int64)), pa.array(deviations(x, m.n, m.sums), pa.int64()).take(again),
                 pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace, len(x)), pa.float64()),
                 pa.array(np.full(rows, m.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = (f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
    if not k:
        return vectors.sparkSession.createDataFrame([], out)
    return vectors.select("x", "vec_id").mapInArrow(score, out)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Each usable row of ``embeddings`` (vec_id, vector) on the leading components of the fit list."""
    vectors = integer_vectors(embeddings, vector)
    # as many rows as there are lengths, and one of them
    top = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top["d"] if top else 0
    same = vectors.filter(F.size("x") == d)
    fit = stage(same.select("x").distinct(), "whitening-fit")
    return project(same, fit_whitening(fit, d, components))
