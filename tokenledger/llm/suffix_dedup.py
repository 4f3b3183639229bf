"""Repeated byte windows by a depth-limited radix sort of suffixes.

A byte is removed when a ``width``-byte string over it also starts in a document
with a smaller id. Suffixes are told apart only through ``width`` bytes, most
significant digit first, and a group that a digit leaves alone drops out:

* Suffixes are taken in runs. The synchronising position of a window is its
  smallest hashed ``GRAM``-byte string (the leftmost of equals); it depends on
  the window's bytes only, so equal windows have it at the same place. Windows
  that follow each other with one position form a run, about 18 windows long.
* Digit 1 is the gram at the position, digit 2 the whole run. Runs are dealt to
  buckets by digit 1 and sorted by digits 1 and 2: equal runs are repeated with
  all their windows, and only the smallest id of a run keeps them.
* Digit 3 is the window. It is needed only for runs that share digit 1 and the
  bytes next to the position on one side, without being equal: such runs give
  their windows to a second sort, whose equal groups are the repeated windows.

A gram of very many different runs (at the border of a passage that a third of
all documents share, each document's own bytes are in the run) is found first, by
bounded counters a task that are summed over the tasks. Its runs are dealt by
digits 1 and 2, and those that are not repeated give their windows without a
look at their neighbours: under so many runs each finds another that shares a
side.

A run or window that very many blocks share has such a gram, so both are looked
for under those grams alone: Spark adds up, a row a distinct string and task, how
many entries each string has and their smallest id. Strings of very many entries
are then decided in the block from this bounded list and are not sent to a bucket.

Digits travel as hashes (32 bits and the bucket for digit 1, 64 bits for digits
2 and 3), so buckets are even. Texts move in compressed blocks of about 1 MB
that are staged once. Inside a block equal runs and windows are one entry with
the block's smallest id, so a string that stands in a third of all documents
costs one entry a block. A bucket answers each block with two bits an entry.

Defined cases: a null text is empty; texts shorter than ``width`` lose nothing; a
null id counts as larger than every id; rows of equal ids do not remove each
other's bytes; every row gives one row, an empty table none; ids are integers;
other columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage
from tokenledger.llm.textblocks import _POWERS, blocks, mix

WIDTH = 50
GRAM = 20
BLOCK_BYTES = 1 << 20
#: buckets of each sort: so many for every shuffle partition of the session, and more if one would have more text
BUCKETS_PER_PARTITION = 4
BUCKET_BYTES = 1 << 27
#: a gram of so many entries is split. A task keeps ``COUNTERS`` grams, so a gram's count falls short by at most one
#: entry in ``COUNTERS``, however thinly its entries lie over the blocks
HOT_ENTRIES = 1 << 16
COUNTERS = 1 << 18
#: entries that a task holds back before it adds them to its counters
PENDING = 1 << 20
#: only the grams of most entries are split, so another has at most a ``HOT_GRAMS``-th of all entries
HOT_GRAMS = 1 << 16

_LAST = np.int64(2**63 - 1)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
_ANY = np.ones(256, dtype=bool)
_NONE = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Shared:
    """Hashes, ordered, of the strings of very many entries, and the smallest document key of each."""
    hashes: np.ndarray
    low: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is one of them, its smallest key) of every hash."""
        if not len(self.hashes):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, self.low[at]


NOTHING = Shared(_NONE, np.zeros(0, np.int64))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by doubling."""
    width = 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < w:
        v = np.minimum(v[:len(v) - (w - width)], v[w - width:])
    return v


@dataclass
class Runs:
    """Runs of windows of one block, and their entries.

    ``first`` / ``last``: first and last window start of each run; ``doc``: its
    text; ``entry``: its entry. Entries are ordered by bucket, digit 1, digit 2;
    ``low`` is the smallest document key among an entry's runs; ``hot``: its gram is
    split over the buckets; ``digit1``: the gram's whole hash.
    """
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    bucket: np.ndarray
    gram: np.ndarray
    run: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    hot: np.ndarray
    digit1: np.ndarray

    def shared(self, runs: Shared) -> tuple[np.ndarray, np.ndarray]:
        """(is a run of very many entries, its smallest key) of every entry."""
        known, low = runs.find(self.string())
        return known & self.hot, low

    def string(self) -> np.ndarray:
        return mix(self.digit1) ^ self.run


class Text:
    """A block: bytes, text bounds, document keys, and hashes of any byte range."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, width: int) -> None:
        self.data, self.bounds, self.keys, self.width = data, bounds, keys, width
        up, self.down = _POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def runs(self, buckets: int, hot: np.ndarray = _NONE, gram: int = GRAM) -> Runs:
        """``hot``: the hashes of the grams to split, ordered."""
        n, width = len(self.data), self.width
        sizes = np.diff(self.bounds)
        if n < width or not (sizes >= width).any():
            none, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return Runs(none, none, none, none, none, h, h, h.astype(np.uint8), h.astype(np.uint8), none,
                        h.astype(bool), h)
        at = np.arange(n - gram + 1)
        h = self.hash(at, at + gram)
        best = _sliding_min((h & _HIGH) | at.astype(np.uint64), width - gram + 1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(doc[:n - width + 1] == doc[width - 1:])
        sync = (best[starts] & _LOW).astype(np.int64)
        new = np.append(True, (sync[1:] != sync[:-1]) | (starts[1:] != starts[:-1] + 1))
        opens = np.flatnonzero(new)
        first, last = starts[opens], starts[np.append(opens[1:], len(starts)) - 1]
        place, owner = sync[opens], doc[first]
        digit1 = h[place]
        digit2 = self.hash(first, last + width) ^ (last - first).astype(np.uint64)
        half = (width - gram) // 2                                # a window reaches so far on one side at least
        left = self._side(place - half, place, place - half >= self.bounds[owner])
        right = self._side(place + gram, place + width - half, place + width - half <= self.bounds[owner + 1])
        split = np.zeros(len(digit1), dtype=bool)
        if len(hot):
            split = hot[np.minimum(np.searchsorted(hot, digit1), len(hot) - 1)] == digit1
        dealt = np.where(split, mix(digit1) ^ digit2, digit1)
        bucket = ((mix(dealt) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.keys[owner], digit2, digit1 & _LOW, bucket))
        b, g, r = bucket[order], (digit1 & _LOW)[order], digit2[order]
        fresh = np.append(True, (b[1:] != b[:-1]) | (g[1:] != g[:-1]) | (r[1:] != r[:-1]))
        head = order[fresh]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        return Runs(first, last, owner, entry, bucket[head], (digit1 & _LOW)[head], digit2[head], left[head],
                    right[head], self.keys[owner[head]], split[head], digit1[head])

    def _side(self, starts: np.ndarray, ends: np.ndarray, there: np.ndarray) -> np.ndarray:
        """A byte (1 to 255) of the range's hash; 0 where the text ends before."""
        out = np.zeros(len(starts), np.uint8)
        out[there] = self.hash(starts[there], ends[there]) % np.uint64(255) + np.uint64(1)
        return out

    def windows(self, runs: Runs, wanted: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """(start, document key, entry of each window; bucket, hash, smallest key of each entry).

        The windows of the runs ``wanted``; entries are distinct windows, ordered by bucket and hash.
        """
        pick = np.flatnonzero(wanted)
        size = runs.last[pick] - runs.first[pick] + 1
        start = np.arange(size.sum()) + np.repeat(runs.first[pick] - (np.cumsum(size) - size), size)
        key = np.repeat(self.keys[runs.doc[pick]], size)
        h = self.hash(start, start + self.width)
        bucket = ((mix(h) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, h, bucket))
        hs, bs = h[order], bucket[order]
        fresh = np.append(True, (hs[1:] != hs[:-1]) | (bs[1:] != bs[:-1]))[:len(order)]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(fresh) - 1
        head = order[fresh]
        return start, key, entry, bucket[head], h[head], key[head]


# -- blocks -------------------------------------------------------------------------------------------------------

def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, sizes, blob: the texts of ``docs`` in compressed blocks, staged."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 32
        packer = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids = batch.column(0)
            for b in blocks(batch.column(1), _ANY, block_bytes=block_bytes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial], pa.int64()), pa.array([ids.slice(b.first, b.n).to_pylist()], pa.list_(pa.int64())),
                     pa.array([np.diff(b.bounds).tolist()], pa.list_(pa.int64())),
                     pa.array([packer.compress(b.data.tobytes())], pa.binary())], ["block", "ids", "sizes", "blob"])
                serial += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stage(rows.mapInArrow(pack, "block long, ids array<long>, sizes array<long>, blob binary"), "suffix-blocks")


def _open(row: dict, width: int) -> Text:
    data = np.frombuffer(zstandard.decompress(row["blob"]) if row["blob"] else b"", np.uint8)
    keys = np.array([_LAST if i is None else i for i in row["ids"]], np.int64)
    return Text(data, np.append(0, np.cumsum(row["sizes"])).astype(np.int64), keys, width)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, plane by plane: the empty high bytes of small numbers compress away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of an ordered bucket column."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(bucket)).tolist()):
        if hi > lo:
            yield int(bucket[lo]), lo, hi


_ENTRIES = "bucket int, block long, data binary"
_ANSWER = "block long, bucket int, bits binary"


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time: a row is a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _entry_rows(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ["bucket", "block", "data"], [pa.int32(), pa.int64(), pa.binary()])


def _sort_buckets(entries: DataFrame, answer) -> DataFrame:
    """Bring each bucket's rows together and let ``answer`` find two flags for every entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, block, data in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != now and held:
                    yield flush(now, held)
                    held = []
                now = bucket
                held.append((block, data))
        if held:
            yield flush(now, held)

    def flush(bucket: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        sizes, one, two = answer([d for _, d in held])
        ends = np.cumsum(sizes)
        return _rows([(block, bucket, _bits(np.concatenate([one[e - n:e], two[e - n:e]])))
                      for (block, _), n, e in zip(held, sizes, ends)],
                     ["block", "bucket", "bits"], [pa.int64(), pa.int32(), pa.binary()])

    return entries.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _ANSWER)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each ordered row) by equal keys, the first most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _spread(order: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> tuple:
    """Smallest ``low`` and largest ``high`` of each row's group, in row order."""
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    a, b = np.empty_like(low), np.empty_like(low)
    a[order] = np.minimum.reduceat(low[order], heads)[group]
    b[order] = np.maximum.reduceat((low if high is None else high)[order], heads)[group]
    return a, b


def _answer_runs(parts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Repeated: the run also stands under a smaller id. Open: its windows must be compared."""
    sizes = [len(p) // 22 for p in parts]
    gram = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(parts, sizes)])
    run = np.concatenate([np.frombuffer(p, "<u8", n, 4 * n) for p, n in zip(parts, sizes)])
    left = np.concatenate([np.frombuffer(p, np.uint8, n, 12 * n) for p, n in zip(parts, sizes)])
    right = np.concatenate([np.frombuffer(p, np.uint8, n, 13 * n) for p, n in zip(parts, sizes)])
    low = np.concatenate([_unplanes(p[14 * n:]) for p, n in zip(parts, sizes)])
    least, _ = _spread(*_groups(gram, run), low)
    repeated = low > least
    wanted = np.zeros(len(low), dtype=bool)
    rest = np.flatnonzero(~repeated)
    for side in (left, right):
        at = rest[side[rest] > 0]
        if len(at):
            grouped = _groups(gram[at], side[at])
            a, b = _spread(*grouped, low[at])
            as_signed = run[at].view(np.int64)
            x, y = _spread(*grouped, as_signed)
            wanted[at[(a < b) & (x < y)]] = True
    return sizes, repeated, wanted


def _answer_windows(parts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    sizes = [len(p) // 16 for p in parts]
    window = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(parts, sizes)])
    low = np.concatenate([_unplanes(p[8 * n:]) for p, n in zip(parts, sizes)])
    least, _ = _spread(*_groups(window), low)
    return sizes, low > least, np.zeros(len(low), dtype=bool)


def _flags(row_bits: list | None, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two flags of every entry, from the buckets' answers to a block."""
    one, two = np.zeros(len(bucket), dtype=bool), np.zeros(len(bucket), dtype=bool)
    bits = {r["bucket"]: r["bits"] for r in row_bits or ()}
    for b, lo, hi in _slices(bucket):
        found = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=2 * (hi - lo)).astype(bool)
        one[lo:hi], two[lo:hi] = found[:hi - lo], found[hi - lo:]
    return one, two


def _collected(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _opened(t: Text, row: dict, buckets: int, hot: np.ndarray, shared: Shared) -> tuple[Runs, np.ndarray, np.ndarray]:
    """(runs; run is repeated; run is open) of a block and its first answers."""
    runs = t.runs(buckets, hot)
    known, least = runs.shared(shared)
    repeated, wanted = known & (runs.low > least), np.zeros(len(known), dtype=bool)
    repeated[~known], wanted[~known] = _flags(row["runs"], runs.bucket[~known])
    mine = t.keys[runs.doc] if len(runs.doc) else runs.doc
    gone = repeated[runs.entry] | (mine > runs.low[runs.entry])
    return runs, gone, ~gone & (wanted | runs.hot)[runs.entry]


def _add_up(grams: list[np.ndarray], counts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of the ``size`` most frequent grams, less the count of the next one; the others drop out."""
    gram, place = np.unique(np.concatenate(grams), return_inverse=True)
    n = np.bincount(place, np.concatenate(counts), len(gram)).astype(np.int64)
    if len(gram) > size:
        n -= np.partition(n, len(n) - size - 1)[len(n) - size - 1]
    return gram[n > 0], n[n > 0]


def hot_grams(packed: DataFrame, width: int = WIDTH, least: int = HOT_ENTRIES, counters: int = COUNTERS) -> np.ndarray:
    """Hashes of the grams that ``least`` entries share, ordered; at most ``HOT_GRAMS``, those of most entries.

    Each task counts its blocks' entries in ``counters`` counters: when there are more grams, the count of the first
    one left out is taken from all, which costs a gram at most one in ``counters`` of the task's entries.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = [_NONE], [np.zeros(0, np.int64)]
        for batch in batches:
            for row in _each(batch):
                for held, more in zip((gram, n), np.unique(_open(row, width).runs(1).digit1, return_counts=True)):
                    held.append(more)
                if sum(map(len, gram[1:])) >= PENDING:
                    gram, n = ([x] for x in _add_up(gram, n, counters))
        kept, many = _add_up(gram, n, counters)
        yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(many)], ["gram", "n"])

    counted = packed.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).collect()
    return np.sort(np.array([r["gram"] for r in top], np.int64).view(np.uint64))


def _n_buckets(packed: DataFrame) -> int:
    """Enough buckets for the session's shuffle partitions and for ``BUCKET_BYTES`` of text in each."""
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(BUCKETS_PER_PARTITION * parts, -(-size // BUCKET_BYTES))


def _most_shared(strings: DataFrame, least: int) -> Shared:
    """The strings (hash, low: a row for each entry) of ``least`` entries; at most ``HOT_GRAMS``, those of most entries."""
    found = strings.groupBy("hash").agg(F.count("*").alias("n"), F.min("low").alias("low")).filter(F.col("n") >= least)
    top = sorted((r["hash"] % 2**64, r["low"]) for r in found.orderBy(F.desc("n"), "hash").limit(HOT_GRAMS).collect())
    return Shared(np.array([h for h, _ in top], np.uint64), np.array([low for _, low in top], np.int64))


def _strings(h: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(low)], ["hash", "low"])


def shared_runs(packed: DataFrame, width: int, hot: np.ndarray, least: int = HOT_ENTRIES) -> Shared:
    """Runs of ``least`` entries; without a hot gram there is none, and the texts are not read."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                r = _open(row, width).runs(1, hot)
                yield _strings(r.string()[r.hot], r.low[r.hot])

    return _most_shared(packed.mapInArrow(strings, "hash long, low long"), least) if len(hot) else NOTHING


def shared_windows(first: DataFrame, width: int, buckets: int, hot: np.ndarray, shared: Shared,
                   least: int = HOT_ENTRIES) -> Shared:
    """Windows of ``least`` entries, from the open runs of hot grams in ``first`` (blocks with their first answers)."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                t = _open(row, width)
                runs, _, opened = _opened(t, row, buckets, hot, shared)
                _, _, _, _, h, low = t.windows(runs, opened & runs.hot[runs.entry], 1)
                yield _strings(h, low)

    return _most_shared(first.mapInArrow(strings, "hash long, low long"), least) if len(hot) else NOTHING


def run_entries(packed: DataFrame, width: int, buckets: int, hot: np.ndarray, shared: Shared = NOTHING) -> DataFrame:
    """bucket, block, data: the run entries of the blocks, 22 bytes each, but for those of ``shared`` runs."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                r, out = _open(row, width).runs(buckets, hot), []
                sent = ~r.shared(shared)[0]
                gram, run, left, right, low = (x[sent] for x in (r.gram, r.run, r.left, r.right, r.low))
                for b, lo, hi in _slices(r.bucket[sent]):
                    out.append((b, row["block"], b"".join([
                        gram[lo:hi].astype("<u4").tobytes(), run[lo:hi].astype("<u8").tobytes(),
                        left[lo:hi].tobytes(), right[lo:hi].tobytes(), _planes(low[lo:hi])])))
                yield _entry_rows(out)

    return packed.mapInArrow(entries, _ENTRIES)


def window_entries(first: DataFrame, width: int, buckets: int, hot: np.ndarray, shared: Shared = NOTHING,
                   same: Shared = NOTHING) -> DataFrame:
    """bucket, block, data: the window entries of the open runs, 16 bytes each, but for the windows of ``same``."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                t = _open(row, width)
                runs, _, opened = _opened(t, row, buckets, hot, shared)
                _, _, _, bucket, h, low = t.windows(runs, opened, buckets)
                sent = ~same.find(h)[0]
                h, low = h[sent], low[sent]
                yield _entry_rows([(b, row["block"], h[lo:hi].astype("<u8").tobytes() + _planes(low[lo:hi]))
                                   for b, lo, hi in _slices(bucket[sent])])

    return first.mapInArrow(entries, _ENTRIES)


def repeated_spans(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, block_bytes: int = BLOCK_BYTES,
                   hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of maximal removed runs, in bytes) and kept (the other bytes)."""
    packed = pack_blocks(docs, block_bytes)
    n_buckets = buckets or _n_buckets(packed)
    hot = hot_grams(packed, width, hot_entries)
    shared = shared_runs(packed, width, hot, hot_entries)
    entries = run_entries(packed, width, n_buckets, hot, shared)
    runs = stage(_collected(_sort_buckets(entries, _answer_runs), "runs"), "suffix-runs")
    first = packed.join(runs, "block", "left")
    same = shared_windows(first, width, n_buckets, hot, shared, hot_entries)
    entries = window_entries(first, width, n_buckets, hot, shared, same)
    windows = stage(_collected(_sort_buckets(entries, _answer_windows), "windows"), "suffix-windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in _each(batch):
                t = _open(row, width)
                r, gone, opened = _opened(t, row, n_buckets, hot, shared)
                start, key, entry, bucket, h, low = t.windows(r, opened, n_buckets)
                known, least = same.find(h)
                elsewhere = known & (low > least)
                elsewhere[~known], _ = _flags(row["windows"], bucket[~known])
                hit = start[elsewhere[entry] | (key > low[entry])] if len(start) else start
                edge = np.zeros(len(t.data) + 1, np.int64)
                np.add.at(edge, r.first[gone], 1)
                np.add.at(edge, r.last[gone] + width, -1)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + width, -1)
                covered = np.cumsum(edge)[:-1] > 0
                rows = []
                for i, (lo, hi) in enumerate(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist())):
                    flags = np.concatenate([[False], covered[lo:hi], [False]])
                    turn = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                    rows.append((row["ids"][i], hi - lo, [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2])],
                                 t.data[lo:hi][~covered[lo:hi]].tobytes()))
                yield _rows(rows, ["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), span, pa.binary()])

    both = runs.join(windows, "block", "left")
    out = packed.join(both, "block", "left").mapInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def remove_repeated(docs: DataFrame, width: int = WIDTH, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    found = repeated_spans(docs, width, **options)
    return found.select("doc_id", "n_bytes", _removed(F.col("spans")).alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS key,
                  hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row, key, p, substr(h, 2 * p + 1, 100) AS w
      FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
r AS (SELECT row, p FROM w JOIN (SELECT w, min(key) AS low FROM w GROUP BY w HAVING min(key) < max(key)) USING (w)
      WHERE low < key),
c AS (SELECT DISTINCT row, unnest(range(p, p + 50)) AS p FROM r),
n AS (SELECT row, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
      FROM (SELECT *, lag(p) OVER (PARTITION BY row ORDER BY p) AS before FROM c) GROUP BY row),
k AS (SELECT row, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS kept
      FROM (SELECT row, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE row IN (SELECT row FROM c)) ANTI JOIN c USING (row, p)
      GROUP BY row)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (row) LEFT JOIN k USING (row)
"""
