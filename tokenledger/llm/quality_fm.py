"""Quality classifier: a factorisation machine.

A document's features are its distinct words (hashed, each weighing one over the
root of their number), structure statistics of its text cut into quantile bins,
and metadata (the stored character count, binned). The score is
``sigmoid(w0 + sum w_i x_i + sum_i<j <v_i, v_j> x_i x_j)``; the pairwise sum is
taken in linear time as half of ``(sum v x)^2 - sum (v x)^2`` in each of the
``RANK`` factors. Language, source, id and labels are no inputs.

The model is fitted on the driver on a bounded sample (``TRAIN_DOCS`` documents a
class of at most ``TRAIN_BYTES`` bytes, weighted back to the class shares) and
broadcast (under 3 MB). Whole texts of all documents are then scored in blocks.

Defined cases: a null or empty text has no words and the lowest statistics; a
missing character count has a bin of its own; every row, repeated ones too,
gives one row; without labels of a class every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.quality_rules import _sums, repeated_words
from tokenledger.llm.samples import held_out, labelled_sample
from tokenledger.llm.textblocks import SPACE_WORD, Block, blocks

TRAIN_DOCS = 2_000
TRAIN_BYTES = 16_384
BITS = 16
RANK = 8
BINS = 8
EPOCHS = 12
BATCH = 64
RATE = 0.1
L2 = 1e-4
STATISTICS = ("words", "word_length", "symbols", "upper", "digits", "marks", "exclamations", "beyond_ascii",
              "repeated", "duplicate_lines", "lines", "distinct", "stored_length")


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_KINDS = [_class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:?\"'()[]{}-_/\\"),
          _class(b"!"), np.arange(256) >= 0xC0]


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: list[np.ndarray]
    constant: float | None = None


def statistics(b: Block, words: np.ndarray, distinct: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """(texts, statistics); ``stored``: the stored character counts, NaN where missing."""
    n = np.diff(b.word_bounds)
    chars = np.maximum(_sums((b.data & 0xC0) != 0x80, b.bounds), 1)
    lines = _sums(b.data == 10, b.bounds) + 1
    per_line = np.zeros(b.n)
    for i in range(b.n):
        parts = [x for x in b.text(i).split(b"\n") if x.strip()]
        per_line[i] = (len(parts) - len(set(parts))) / max(1, len(parts))
    some = np.maximum(n, 1)
    rows = [n, chars / some, *[_sums(kind[b.data], b.bounds) / chars for kind in _KINDS],
            repeated_words(b, words) / some, per_line, lines / some, distinct / some, stored]
    return np.stack([np.asarray(r, dtype=float) for r in rows], axis=1)


def inputs(b: Block, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each distinct word, its index, statistics)."""
    words = b.word_hashes()
    key = np.unique((b.doc.astype(np.uint64) << np.uint64(BITS)) | (words & np.uint64((1 << BITS) - 1)))
    doc, index = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return doc, index, statistics(b, words, np.bincount(doc, minlength=b.n), stored)


def _bins(stats: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(texts, statistics) indices behind the words: BINS bins a statistic and one for missing."""
    cols = []
    for j, e in enumerate(edges):
        x = stats[:, j]
        cols.append((1 << BITS) + j * (BINS + 1) + np.where(np.isnan(x), BINS, np.searchsorted(e, x, "right")))
    return np.stack(cols, axis=1)


def assemble(b: Block, stored: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index, value) of all features of a block, ordered by text."""
    doc, index, stats = inputs(b, stored)
    return _join(doc, index, _bins(stats, edges), b.n)


def _join(doc: np.ndarray, index: np.ndarray, bins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.bincount(doc, minlength=n)
    value = 1 / np.sqrt(m[doc])
    docs = np.concatenate([doc, np.repeat(np.arange(n), bins.shape[1])])
    order = np.argsort(docs, kind="stable")
    x = np.concatenate([value, np.full(bins.size, 1 / np.sqrt(bins.shape[1]))])
    return docs[order], np.concatenate([index, bins.reshape(-1)])[order], x[order]


def margin(model: Model, doc: np.ndarray, index: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """w0 + linear + pairwise terms of ``n`` texts, in time linear in the features."""
    z = np.bincount(doc, weights=model.w[index] * x, minlength=n) + model.w0
    for f in range(model.v.shape[1]):
        vx = model.v[index, f] * x
        z += 0.5 * (np.bincount(doc, weights=vx, minlength=n) ** 2 - np.bincount(doc, weights=vx * vx, minlength=n))
    return z


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: pa.Array, stored: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> Model:
    """Adagrad on the weighted log loss, in small batches, in a fixed order."""
    size = (1 << BITS) + len(STATISTICS) * (BINS + 1)
    total = sizes.get(0, 0) + sizes.get(1, 0)
    if not (y == 0).any() or not (y == 1).any():
        return Model(0.0, np.zeros(size), np.zeros((size, RANK)), [], sizes.get(1, 0) / total if total else 0.0)
    docs, index, stats, at = [], [], [], 0
    for b in blocks(texts, SPACE_WORD):
        d, i, s = inputs(b, stored[b.first:b.first + b.n])
        docs.append(d + at)
        index.append(i)
        stats.append(s)
        at += b.n
    stats_all = np.concatenate(stats)
    edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if not np.isnan(c).all() else np.zeros(0)
             for c in stats_all.T]
    doc, feature, x = _join(np.concatenate(docs), np.concatenate(index), _bins(stats_all, edges), at)
    bounds = np.searchsorted(doc, np.arange(at + 1))
    share = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    share = share / share.mean()
    rng = np.random.default_rng(7)
    w0, w, v = 0.0, np.zeros(size), rng.normal(scale=0.05, size=(size, RANK))
    s0, sw, sv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(at)
        for lo in range(0, at, BATCH):
            pick = order[lo:lo + BATCH]
            rows = np.concatenate([np.arange(bounds[p], bounds[p + 1]) for p in pick])
            local = np.repeat(np.arange(len(pick)), bounds[pick + 1] - bounds[pick])
            used, i = np.unique(feature[rows], return_inverse=True)
            xv, ww, vv = x[rows], w[used], v[used]
            vx = vv[i] * xv[:, None]
            s = np.zeros((len(pick), RANK))
            np.add.at(s, local, vx)
            sq = np.bincount(local, weights=(vx * vx).sum(axis=1), minlength=len(pick))
            z = w0 + np.bincount(local, weights=ww[i] * xv, minlength=len(pick)) + 0.5 * ((s * s).sum(axis=1) - sq)
            g = share[pick] * (sigmoid(z) - y[pick])
            gx = (g[local] * xv)
            gw = np.bincount(i, weights=gx, minlength=len(used)) + L2 * ww
            gv = np.zeros((len(used), RANK))
            np.add.at(gv, i, gx[:, None] * (s[local] - vx))
            gv += L2 * vv
            s0 += g.sum() ** 2
            sw[used] += gw * gw
            sv[used] += gv * gv
            w0 -= RATE * g.sum() / np.sqrt(s0)
            w[used] -= RATE * gw / np.sqrt(sw[used])
            v[used] -= RATE * gv / np.sqrt(sv[used])
    return Model(w0, w.astype(np.float32), v.astype(np.float32), edges)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model:
    sample, sizes = labelled_sample(docs, labels, "quality", per_class, max_bytes)
    stored = sample.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    return fit(sample.column("text"), stored, sample.column("label").to_numpy(), sizes)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any others) with ``score`` added at the end."""
    docs = docs.drop("score")
    at, length = docs.columns.index("text"), docs.columns.index("n_chars")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            stored = batch.column(length).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out = [np.zeros(0)]
            for b in blocks(batch.column(at), SPACE_WORD):
                if m.constant is not None:
                    out.append(np.full(b.n, m.constant))
                    continue
                out.append(sigmoid(margin(m, *assemble(b, stored[b.first:b.first + b.n], m.edges), b.n)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())],
                                             [*batch.schema.names, "score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = score_quality(docs.select("doc_id", "text", "n_chars"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
