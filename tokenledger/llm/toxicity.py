"""Toxicity by a linear-chain conditional random field over words.

Two states (clean, toxic) per word. Emission features are hashes of the word,
its first 3 to 9 bytes and its last 2 to 4 bytes. Labelled tokens come from the
labelled training documents: a word of a toxic document is a toxic token when
one of its features is ``RATIO`` times as frequent in toxic documents as in
clean ones (a lower confidence bound of the ratio) and occurs in ``MIN_DOCS`` toxic
documents; near copies in the sample are left out; all words of clean documents
are clean tokens. The model is fitted on the driver on a bounded sample
(``TRAIN_DOCS`` documents a class, ``TRAIN_BYTES`` bytes each at most) and
broadcast (2 MB).

Every document is one chain over its whole text, however long: forward and
backward passes run over blocks of documents as scans of 2x2 transfer matrices.
The marginals give each word's probability; a document's score is a logistic
function of their expected count, their maximum and the text's length, fitted on
the same sample. ``spans`` gives the offsets of runs of offending words.

Defined cases: a null or empty text has no words and gets the score of an empty
chain; every row, repeated ones too, gives one row; null ids are never training
rows; without any labels of a class every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenledger.llm.samples import held_out, labelled_sample, without_copies
from tokenledger.llm.staging import numbered, renamed
from tokenledger.llm.textblocks import ALNUM_WORD, _POWERS, Block, blocks, mix
from pyspark.sql import functions as F

TRAIN_DOCS = 1_000
TRAIN_BYTES = 16_384
BITS = 18
RATIO = 6.0
MIN_COUNT = 8
MIN_DOCS = 5
CLIP = 3
ROUNDS = 40
CHUNK = 256
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
SUFFIXES = (2, 3, 4)


@dataclass
class Model:
    weights: np.ndarray                                       # of label 1 against label 0, by feature
    start: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None


def features(b: Block) -> np.ndarray:
    """(features, words) indices into the weights."""
    p, (_, down) = b.prefix(), _POWERS.get(len(b.data) + 1)
    s, e, out = b.starts, b.ends, []
    low, mask = down[s], np.uint64((1 << BITS) - 1)
    out.append(mix((p[e] - p[s]) * low) & mask)
    for n in PREFIXES:
        cut = np.minimum(s + n, e)
        out.append(mix((p[cut] - p[s]) * low + np.uint64(n)) & mask)
    for n in SUFFIXES:
        cut = np.maximum(e - n, s)
        out.append(mix((p[e] - p[cut]) * down[cut] + np.uint64(64 + n)) & mask)
    return np.array(out, dtype=np.int32).reshape(len(out), len(s))


def emissions(f: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of label 1 of each word, one feature at a time."""
    out = np.zeros(f.shape[1])
    for row in f:
        out += weights[row]
    return out


def _scan(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Prefix products of 2x2 matrices applied to (1, 1): ratios v1 / v0 after each.

    ``m``: (4, n) entries 00, 01, 10, 11; a matrix with equal columns restarts
    the chain. Chunks of CHUNK matrices are multiplied side by side.
    """
    n = m.shape[1]
    rows = -(-n // CHUNK)
    pad = np.zeros((4, rows * CHUNK))
    pad[0] = pad[3] = 1.0
    pad[:, :n] = m
    a = pad.reshape(4, rows, CHUNK).transpose(0, 2, 1).copy()              # (4, CHUNK, rows)
    p00, p01, p10, p11 = (a[i, 0].copy() for i in range(4))
    for t in range(1, CHUNK):
        x00, x01, x10, x11 = a[:, t]
        p00, p10, p01, p11 = (x00 * p00 + x01 * p10, x10 * p00 + x11 * p10,
                              x00 * p01 + x01 * p11, x10 * p01 + x11 * p11)
        top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
        p00, p01, p10, p11 = p00 / top, p01 / top, p10 / top, p11 / top
    v0, v1 = np.empty(rows), np.empty(rows)
    u0, u1 = 1.0, 1.0
    for r, (c00, c01, c10, c11) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist())):
        v0[r], v1[r] = u0, u1
        u0, u1 = c00 * u0 + c01 * u1, c10 * u0 + c11 * u1
        top = max(u0, u1)
        u0, u1 = u0 / top, u1 / top
    out = np.empty((CHUNK, rows))
    for t in range(CHUNK):
        x00, x01, x10, x11 = a[:, t]
        v0, v1 = x00 * v0 + x01 * v1, x10 * v0 + x11 * v1
        top = np.maximum(v0, v1)
        v0, v1 = v0 / top, v1 / top
        out[t] = v1 / np.maximum(v0, 1e-300)
    return out.T.reshape(-1)[:n]


def chain(scores: np.ndarray, bounds: np.ndarray, start: float, trans: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of label 1, forward ratios, backward ratios) of texts whose words lie at ``bounds``."""
    n = len(scores)
    if n == 0:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    e = np.exp(np.clip(scores, -30, 30))
    t = np.exp(np.clip(trans, -20, 20))
    lo, hi = bounds[:-1], bounds[1:]
    lo, hi = lo[hi > lo], hi[hi > lo]
    m = np.empty((4, n))
    m[0], m[1], m[2], m[3] = t[0, 0], t[1, 0], e * t[0, 1], e * t[1, 1]
    s = np.exp(start)
    m[0, lo], m[1, lo], m[2, lo], m[3, lo] = 1.0, 1.0, e[lo] * s, e[lo] * s
    forward = _scan(m, lo)
    nxt = np.append(e[1:], 1.0)
    m[0], m[1], m[2], m[3] = t[0, 0], t[0, 1] * nxt, t[1, 0], t[1, 1] * nxt
    m[:, hi - 1] = 1.0
    backward = _scan(m[:, ::-1], lo)[::-1]
    q = forward * backward
    return q / (1 + q), forward, backward


def chain_in_parts(scores: np.ndarray, bounds: np.ndarray, start: float, trans: np.ndarray, words: int = 1 << 17
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``chain`` over texts of about ``words`` words at a time, so that its working arrays stay small."""
    out, i = [], 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + words, "right")) - 1)
        out.append(chain(scores[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], start, trans))
        i = j
    return tuple(np.concatenate(x) for x in zip(*out)) if out else chain(scores, bounds, start, trans)


def _clipped(index: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, at most CLIP a document; documents) of each feature."""
    pair, n = np.unique(index * np.int64(n_docs) + doc, return_counts=True)
    feature = pair // n_docs
    return (np.bincount(feature, weights=np.minimum(n, CLIP), minlength=1 << BITS),
            np.bincount(feature, minlength=1 << BITS))


def _token_labels(f: np.ndarray, toxic: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Toxic tokens by distant supervision; ``toxic``: label of each word's document ``doc``."""
    n_docs = np.int64(doc.max(initial=0) + 1)
    best = np.zeros(f.shape[1], dtype=bool)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for row in f:
        a, spread = _clipped(row[toxic], doc[toxic], n_docs)
        c, _ = _clipped(row[~toxic], doc[~toxic], n_docs)
        low = np.log((a + 0.5) / n1) - np.log((c + 0.5) / n0) - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        best |= ((low > np.log(RATIO)) & (a >= MIN_COUNT) & (spread >= MIN_DOCS))[row]
    return best & toxic


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 4): 1, log expected toxic words, log words, largest marginal's logit."""
    sums = np.append(0.0, np.cumsum(p))
    n = np.diff(bounds)
    expected = np.maximum(sums[bounds[1:]] - sums[bounds[:-1]], 0)
    top = np.zeros(len(n))
    has = np.flatnonzero(n > 0)
    if len(has):
        top[has] = np.maximum.reduceat(p, bounds[:-1][has])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(n)), np.log(expected + 0.05), np.log1p(n), np.log(top / (1 - top))], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: pa.Array, toxic: np.ndarray, sizes: dict[int, int]) -> Model:
    """Fit the chain and the document score on a sample; ``sizes``: training labels of each class."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    own = without_copies(texts)
    texts, toxic = texts.take(pa.array(own)), toxic[own]
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    if not n0 or not n1:
        total = sizes.get(0, 0) + sizes.get(1, 0)
        return Model(np.zeros(1 << BITS), constant=sizes.get(1, 0) / total if total else 0.0)
    parts, counts = [], []
    for b in blocks(texts, ALNUM_WORD, lower=True):
        parts.append(features(b))
        counts.append(np.diff(b.word_bounds))
    f, n = np.concatenate(parts, axis=1), np.concatenate(counts)
    del parts
    bounds = np.append(0, np.cumsum(n))
    y = _token_labels(f, np.repeat(toxic == 1, n), np.repeat(np.arange(len(n)), n))
    y1 = y.astype(float)
    inner = np.ones(len(y), dtype=bool)
    inner[bounds[:-1][n > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    first = bounds[:-1][n > 0]
    weights, start, trans = np.zeros(1 << BITS), 0.0, np.zeros((2, 2))
    size, rate = (np.zeros(1 << BITS), np.zeros(5)), 0.5
    for _ in range(ROUNDS):                                   # Adagrad on the log likelihood
        scores = emissions(f, weights)
        p, a, back = chain_in_parts(scores, bounds, start, trans)
        g = np.zeros(1 << BITS)
        for row in f:
            g += np.bincount(row, weights=y1 - p, minlength=1 << BITS)
        g -= 0.01 * weights
        e, t = np.exp(np.clip(scores, -30, 30)), np.exp(np.clip(trans, -20, 20))
        tail = e[at] * back[at]
        q = np.stack([np.full(len(at), t[0, 0]), t[0, 1] * tail, a[at - 1] * t[1, 0], a[at - 1] * t[1, 1] * tail])
        want = (q / q.sum(axis=0)).sum(axis=1)
        gt = np.append(seen.reshape(-1) - want, (y1[first] - p[first]).sum())
        size[0][:] += g * g
        size[1][:] += gt * gt
        weights += rate * g / np.sqrt(size[0] + 1e-9)
        step = rate * gt / np.sqrt(size[1] + 1e-9)
        trans, start = trans + step[:4].reshape(2, 2), start + step[4]
    p, _, _ = chain_in_parts(emissions(f, weights), bounds, start, trans)
    scale = np.where(toxic == 1, sizes.get(1, n1) / n1, sizes.get(0, n0) / n0)
    x = document_features(p, bounds)
    doc = _fit_logistic(x, toxic.astype(float), scale / scale.mean())
    # classes that lie apart: put one half midway between them, not where the few clean outliers of a sample leave it
    low, high = np.quantile((x @ doc)[toxic == 1], 0.1), np.quantile((x @ doc)[toxic == 0], 0.995)
    if low > high:
        doc[0] -= max(0.0, (low + high) / 2)
    return Model(weights.astype(np.float32), start, trans, doc)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Model:
    sample, sizes = labelled_sample(docs, labels, "toxic", per_class, max_bytes)
    return fit(sample.column("text"), sample.column("label").to_numpy(), sizes)


def _spans(b: Block, p: np.ndarray, i: int) -> list[dict]:
    """Byte offsets (end exclusive) of runs of words that are more likely toxic than not."""
    lo, hi = b.word_bounds[i], b.word_bounds[i + 1]
    bad = np.flatnonzero(p[lo:hi] >= 0.5)
    if not len(bad):
        return []
    cuts = np.flatnonzero(np.diff(bad) > 1) + 1
    base = int(b.bounds[i])
    return [{"start": int(b.starts[lo + r[0]]) - base, "end": int(b.ends[lo + r[-1]]) - base}
            for r in np.split(bad, cuts)]


def scored(texts: pa.Array, m: Model) -> Iterator[tuple[np.ndarray, np.ndarray | None, Block]]:
    """(document scores, word marginals or None, block) of the texts, about 1 MB at a time."""
    for b in blocks(texts, ALNUM_WORD, lower=True):
        if m.constant is not None:
            yield np.full(b.n, m.constant), None, b
            continue
        p, _, _ = chain(emissions(features(b), m.weights), b.word_bounds, m.start, m.trans)
        yield sigmoid(document_features(p, b.word_bounds) @ m.doc), p, b


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and spans (byte offsets of offending runs) added at the end.

    All other columns pass through; columns already named so are replaced.
    """
    from pyspark.sql import types as T
    docs = docs.drop("score", "spans")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", kind)])
    arrow_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [np.zeros(0)], []
            for part, p, b in scored(batch.column(at), shared.value):
                scores.append(part)
                spans.extend([] if p is None else _spans(b, p, i) for i in range(b.n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores), pa.float64()), pa.array(spans, arrow_kind)],
                [*batch.schema.names, "score", "spans"])

    return docs.mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged, whatever their columns are called.

    The rows pass the scorer once and are filtered there. Null and empty texts score like any other, repeated rows
    share their verdict, an empty table gives an empty one.
    """
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for s, _, _ in scored(batch.column(at), shared.value)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < threshold))

    named = docs.select(*numbered(docs.columns))
    return named.mapInArrow(keep, named.schema).select(*renamed(docs.columns))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row of ``docs``."""
    model = train(docs, labels)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
