"""SimHash near duplicates by the general pigeonhole principle.

Fingerprints (64 bits, word shingles) are computed in one pass over the texts;
equal fingerprints become one row. Links are pairs within ``DISTANCE`` bits:

* the 64 bits are grouped into partitions so that correlated bits share one
  (bit co-occurrences over all fingerprints);
* partition p gets a threshold t_p with sum t_p = distance - partitions + 1:
  a pair within the distance is then within t_p in some partition p. Dynamic
  programming picks the thresholds with the least estimated work (candidates
  from the bits' frequencies, plus probes);
* every fingerprint is filed under its value in each partition and probes the
  values within t_p bits of it (only larger ones: of two values one is larger);
* fingerprints that meet are verified on all 64 bits inside the task. A bucket
  gives the edges of a spanning forest of its links, never all its pairs.

A bucket filed under by more than ``BUCKET_ROWS`` fingerprints, or probed from
such a one, is dealt again: the bits outside its partition are partitioned in the
same way, and its rows meet only under keys of both levels. Such a key fixes all
but a few bits, so its bucket is bounded.
Components come from distributed star contractions over the edges.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; null ids count last in ``component_id`` (null if no other is
reachable); repeated rows give a row each; an empty table gives an empty result;
a text of any length is fingerprinted whole; other columns are not read by
``near_duplicates`` and pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.components import components
from tokenledger.llm.staging import numbered, renamed, row_key, stage, without
from tokenledger.llm.textblocks import SPACE_WORD, Block, blocks
from tokenledger.llm.xxh64 import hash_ranges

SHINGLE = 3
DISTANCE = 3
PARTITIONS = 2
BUCKET_ROWS = 4_096
_LANE = np.uint64(0x0101010101010101)


def _joined(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, word starts) of the block's words, each followed by one space."""
    size = b.ends - b.starts + 1
    start = np.append(0, np.cumsum(size))
    source = np.arange(start[-1]) + np.repeat(b.starts - start[:-1], size)
    out = b.data[np.minimum(source, len(b.data) - 1)] if len(b.data) else np.zeros(0, np.uint8)
    out[start[1:] - 1] = 32
    return out, start


def fingerprints(b: Block, k: int = SHINGLE) -> np.ndarray:
    """SimHash of each text of a lower-cased block (uint64; 0 without words)."""
    out = np.zeros(b.n, np.uint64)
    if not len(b.starts):
        return out
    data, start = _joined(b)
    n = np.diff(b.word_bounds)
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    has = np.flatnonzero(shingles)
    first = np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles - b.word_bounds[:-1], shingles)
    width = np.repeat(np.minimum(n, k), shingles)
    h = hash_ranges(data, start[first], start[first + width] - 1)
    # bits are counted in byte lanes over runs of at most 255 shingles of one text
    runs = -(-shingles[has] // 255)
    offset = (np.cumsum(shingles) - shingles)[has]
    step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = np.repeat(offset, runs) + 255 * step
    owner = np.cumsum(runs) - runs
    bits = np.empty((64, len(has)), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANE, cuts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
        bits[j::8] = counts.T
    majority = 2 * bits > shingles[has]
    for i in range(64):
        out[has] |= majority[i].astype(np.uint64) << np.uint64(i)
    return out


def with_fingerprint(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fp`` (the fingerprint's 64 bits as a signed long) in place of the text, which is not sent back."""
    docs = docs.drop("fp")
    at = docs.columns.index("text")
    others = [i for i in range(len(docs.columns)) if i != at]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [np.zeros(0, np.uint64), *[fingerprints(b, k) for b in blocks(batch.column(at), SPACE_WORD, lower=True)]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in others], pa.array(np.concatenate(fp).view(np.int64))],
                [*[batch.schema.names[i] for i in others], "fp"])

    return docs.mapInArrow(add, T.StructType([*[docs.schema.fields[i] for i in others], T.StructField("fp", T.LongType())]))


# -- partitions and thresholds ------------------------------------------------------------------------------------

def bit_counts(unique: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += bits.T @ bits
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(total.reshape(-1), n).astype(np.int64).reshape(1, -1).tolist(),
                                                   pa.list_(pa.int64()))], ["c"])

    rows = (unique.select("fp").mapInArrow(count, "c array<long>").select(F.posexplode("c").alias("i", "c"))
            .groupBy("i").agg(F.sum("c").alias("c")).collect())                        # 4,097 rows
    flat = np.zeros(64 * 64 + 1)
    for r in rows:
        flat[r["i"]] = r["c"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(bits: list[int], parts: int, n: int, together: np.ndarray) -> list[list[int]]:
    """Partitions of equal width; each is grown by the bit most correlated with it."""
    f = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(f, f)
    dev = np.sqrt(np.maximum(np.outer(f * (1 - f), f * (1 - f)), 1e-12))
    corr = np.abs(cov / dev)
    np.fill_diagonal(corr, 0)
    left, out = list(bits), []
    for p in range(parts):
        width = len(left) // (parts - p)
        part = [max(left, key=lambda b: (corr[b][left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b][part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def _within(part: list[int], f: np.ndarray, upto: int) -> float:
    """Chance that two fingerprints differ in at most ``upto`` bits of ``part``, bits taken as independent."""
    dist = np.zeros(upto + 2)
    dist[0] = 1.0
    for b in part:
        q = 2 * f[b] * (1 - f[b])
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return float(dist[:upto + 1].sum())


def thresholds(parts: list[list[int]], distance: int, n: int, f: np.ndarray) -> list[int]:
    """Thresholds (-1: not probed) of least estimated work with sum distance - parts + 1."""
    def work(part: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        probes = sum(math.comb(len(part), i) for i in range(t + 1))
        return n * probes + 0.5 * n * n * _within(part, f, t)

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                found = (cost + work(part, t), [*chosen, t])
                if used + t not in step or found < step[used + t]:
                    step[used + t] = found
        best = step
    return best[distance - len(parts) + 1][1]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _flips(bits: list[int], upto: int) -> np.ndarray:
    """XOR masks of 1 .. upto of the bits."""
    return np.array([_mask(list(c)) for r in range(1, upto + 1) for c in itertools.combinations(bits, r)], np.uint64)


class Scheme:
    """Partitions of some bits with their thresholds."""

    def __init__(self, bits: list[int], parts: int, distance: int, n: int, together: np.ndarray) -> None:
        self.parts = group_bits(bits, min(parts, len(bits)), n, together)
        self.limits = thresholds(self.parts, distance, n, np.diag(together) / max(n, 1))
        self.masks = [np.uint64(_mask(p)) for p in self.parts]
        self.flips = [_flips(p, t) for p, t in zip(self.parts, self.limits)]


def _batch(parts: list[tuple[int, np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
    """Rows part, key, fp, probe."""
    part = np.concatenate([np.full(len(k), p, np.int32) for p, k, _, _ in parts] or [np.zeros(0, np.int32)])
    key = np.concatenate([k for _, k, _, _ in parts] or [np.zeros(0, np.uint64)])
    fp = np.concatenate([f for _, _, f, _ in parts] or [np.zeros(0, np.uint64)])
    probe = np.concatenate([np.full(len(k), q) for _, k, _, q in parts] or [np.zeros(0, bool)])
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)),
                                       pa.array(probe.astype(bool))], ["part", "key", "fp", "probe"])


_META = "part int, key long, fp long, probe boolean"


def deal(unique: DataFrame, scheme: Scheme) -> DataFrame:
    """Index and probe rows of every fingerprint under the scheme's partitions."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            everything = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(everything), 4096):
                fp, out = everything[lo:lo + 4096], []
                for p, limit in enumerate(scheme.limits):
                    if limit < 0:
                        continue
                    key = fp & scheme.masks[p]
                    out.append((p, key, fp, False))
                    for flip in scheme.flips[p]:
                        other = key ^ flip
                        up = other > key
                        out.append((p, other[up], fp[up], True))
                yield _batch(out)

    return unique.select("fp").mapInArrow(rows, _META)


def deal_again(rows: DataFrame, scheme: Scheme, below: list[Scheme]) -> DataFrame:
    """Rows of crowded buckets under keys of both levels.

    Two index rows of a bucket meet as in ``deal``; a probe row is the only one
    of its pair that looks, so it probes smaller values too.
    """
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, fp = (batch.column(i).to_numpy() for i in range(3))
            key, fp, probe = key.view(np.uint64), fp.view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 4096):
                out = []
                for p in np.unique(part[lo:lo + 4096]).tolist():
                    at = lo + np.flatnonzero(part[lo:lo + 4096] == p)
                    for s, limit in enumerate(below[p].limits):
                        if limit < 0:
                            continue
                        name = len(scheme.parts) + p * len(below[p].parts) + s
                        own = fp[at] & below[p].masks[s]
                        for looks in (False, True):
                            pick = at[probe[at] == looks]
                            out.append((name, key[pick] | own[probe[at] == looks], fp[pick], looks))
                        for flip in below[p].flips[s]:
                            other = own ^ flip
                            go = probe[at] | (other > own)
                            out.append((name, key[at][go] | other[go], fp[at][go], True))
                yield _batch(out)

    return rows.mapInArrow(again, _META)


# -- verification -------------------------------------------------------------------------------------------------

def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(tree of each fingerprint, edges of a spanning forest of the links among ``fp``)."""
    tree, edges = np.full(len(fp), -1), []
    rest = np.arange(len(fp))
    while len(rest):
        root, queue = rest[0], [rest[0]]
        tree[root], rest = root, rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= distance
            found = rest[near]
            tree[found] = root
            edges.extend((int(at), int(x)) for x in found)
            queue.extend(found.tolist())
            rest = rest[~near]
    return tree, edges


def _bucket(index: np.ndarray, probes: np.ndarray, distance: int, first: bool, tree: np.ndarray | None
            ) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Edges of one bucket's index rows (once) and of some of its probe rows."""
    out: list[tuple[int, int]] = []
    if first:
        tree, edges = _forest(index, distance)
        out += [(int(index[a]), int(index[b])) for a, b in edges]
    step = max(1, (1 << 22) // max(1, len(index)))
    for lo in range(0, len(probes), step):
        part = probes[lo:lo + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ index[None, :]) <= distance)
        _, one = np.unique(i * len(index) + tree[j], return_index=True)       # one edge a probe and tree
        out += zip(part[i[one]].tolist(), index[j[one]].tolist())
    return tree, out


def verify(rows: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) among the rows that meet under a key; index rows come first in each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None                      # the open bucket: its name, index rows, forest
        index, tree, first = np.zeros(0, np.uint64), None, True
        for batch in batches:
            part, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp, probe = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            new = np.append(True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(fp))
            # buckets that begin and end here matter only with two rows and an index row first
            worth = (ends - starts > 1) & ~probe[starts]
            worth[0] = worth[-1] = True
            out: list[tuple[int, int]] = []
            for s, e in zip(starts[worth].tolist(), ends[worth].tolist()):
                name = (part[s], key[s])
                if name != now:
                    if now is not None and first and len(index) > 1:          # a bucket without probes ended
                        out += _bucket(index, index[:0], distance, True, None)[1]
                    now, index, tree, first = name, np.zeros(0, np.uint64), None, True
                cut = s + int(np.searchsorted(probe[s:e], True))
                if cut > s:
                    index = np.concatenate([index, fp[s:cut]])
                if cut < e and len(index):
                    tree, edges = _bucket(index, fp[cut:e], distance, first, tree)
                    first = False
                    out += edges
            yield _edges(out)
        if now is not None and first and len(index) > 1:
            yield _edges(_bucket(index, index[:0], distance, True, None)[1])

    sorted_rows = rows.repartition("part", "key").sortWithinPartitions("part", "key", "probe")
    return sorted_rows.mapInArrow(run, "u long, v long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], ["u", "v"])


def _crowded(unique: DataFrame, scheme: Scheme, bucket_rows: int) -> DataFrame:
    """(part, key) of buckets with more than ``bucket_rows`` index rows and of all that those rows probe.

    A bucket left out has few index rows, and so has every bucket that probes it.
    """
    found = None
    for p, limit in enumerate(scheme.limits):
        if limit < 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(int(scheme.masks[p].view(np.int64))))
        full = (unique.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > bucket_rows).select("key"))
        flips = F.array(*[F.lit(int(x)) for x in np.append(np.uint64(0), scheme.flips[p]).view(np.int64)])
        near = full.select(F.lit(p).alias("part"), F.explode(flips).alias("flip"), "key").select(
            "part", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
        found = near if found is None else found.unionByName(near)
    return found.distinct()


def links(unique: DataFrame, distance: int = DISTANCE, parts: int = PARTITIONS, bucket_rows: int = BUCKET_ROWS
          ) -> DataFrame:
    """Edges that connect all fingerprints (column fp, each once) within ``distance`` bits."""
    n, together = bit_counts(unique)
    scheme = Scheme(list(range(64)), parts, distance, n, together)
    rows = deal(unique, scheme)
    crowded = stage(_crowded(unique, scheme, bucket_rows), "simhash-crowded")
    if crowded.isEmpty():
        return verify(rows, distance)
    below = [Scheme([b for b in range(64) if b not in p], parts, distance, n, together) for p in scheme.parts]
    calm = rows.join(crowded, ["part", "key"], "left_anti")
    again = deal_again(rows.join(crowded, ["part", "key"]).select("part", "key", "fp", "probe"), scheme, below)
    return verify(calm.unionByName(again), distance)


def near_duplicate_groups(docs: DataFrame, k: int = SHINGLE, distance: int = DISTANCE, parts: int = PARTITIONS,
                          bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): all columns but the text, and fp, of every row of ``docs`` (doc_id, text, more); fp, root (a
    fingerprint), component_id of every fingerprint."""
    rows = stage(with_fingerprint(docs, k), "simhash-rows")
    unique = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-unique")
    edges = stage(links(unique, distance, parts, bucket_rows), "simhash-links")
    roots = components(edges, "u", "v").select(F.col("node").alias("fp"), "root")
    linked = unique.join(roots, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    joined = stage(linked.join(lowest, "root").select("fp", "root", "lowest"), "simhash-groups")
    groups = unique.join(joined, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    return rows, groups


def near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text)."""
    rows, groups = near_duplicate_groups(docs.select("doc_id", "text"), **options)
    return rows.join(groups.drop("root"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                          "component_id")


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """One row of every group of near duplicates: that of the smallest id (null ids last), with all its columns.

    Rows of one id in one group are told apart by ``row_key``; rows equal in it are repeated rows, and one of them
    stays. Texts are read twice and not shuffled: the rows that go are taken out by their keys (see ``without``);
    of a winner that is repeated, all rows are taken out and one is put back.
    """
    key = row_key(docs)
    rows, groups = near_duplicate_groups(docs.select("doc_id", key.alias("key"), "text"), **options)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    best = (rows.groupBy("fp").agg(F.min(first).alias("best")).join(groups, "fp")
            .groupBy("root").agg(F.min("best").alias("best")).select("best.key", F.lit(True).alias("wins")))
    verdict = stage(rows.groupBy("key").count().join(best, "key", "left"), "simhash-verdict")
    gone = verdict.filter("wins is null or count > 1").select("key")
    out = without(docs, key, gone)
    again = verdict.filter("wins and count > 1").select("key")
    if again.isEmpty():
        return out
    named = docs.select(*numbered(docs.columns), key.alias("key")).join(again, "key", "left_semi")
    whole = F.struct(*[F.col(f"c{i}") for i in range(len(docs.columns))])
    one = named.groupBy("key").agg(F.first(whole).alias("whole")).select("whole.*")
    return out.unionByName(one.select(*renamed(docs.columns)))
