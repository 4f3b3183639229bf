"""Benchmark decontamination by winnowing.

A span counts when ``window`` consecutive item words (a shorter item: all its
words) stand in a document. Both sides are fingerprinted by winnowing: a window's
fingerprint is the minimum of its ``window - k + 1`` k-word hashes, so a shared
window has one fingerprint at one place on both sides. Documents keep only windows
whose fingerprint is set in a bitmap of the benchmark's, with 128 bits of BLAKE2b
of the window's words. The join is on fingerprint and words, so equal hashes of
different words are dropped, and hits that follow each other extend to the whole
shared span. No text is joined.

The benchmark is pre-aggregated before the join: each distinct window is one row,
with the name of the set of items that hold it. A passage of many items thus costs
a document one row a window, not one an item. Items with the same words are one
class; sets are named by sums over their classes, never gathered, and each distinct
union of sets is expanded to item ids once.

The bitmap has 64 bits a benchmark window, ``BITMAP_BITS`` at most; a larger
benchmark fills it and only lets more rows through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage, without
from tokenledger.llm.textblocks import ALNUM_WORD, Block, blocks

WINDOW = 13
GRAM = 5
#: bits of the benchmark's bitmap: at least, at most (32 MB)
LEAST_BITS = 1 << 20
BITMAP_BITS = 1 << 28
#: up to so many benchmark windows (some 110 bytes each) are broadcast; more are joined by shuffle, salted
BROADCAST_ROWS = 200_000
SALTS = 16

_WINDOW = "hash:bigint,window:binary,at:int,n:int"
_FOUND = pa.struct([("hash", pa.int64()), ("window", pa.binary()), ("at", pa.int32()), ("n", pa.int32())])


def winnow(b: Block, words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, minimum k-gram hash) of every ``window`` words of a text."""
    at, h = b.gram_hashes(words, k)
    w = window - k + 1
    if len(h) < w:
        return at[:0], h[:0]
    low = np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)
    full = np.flatnonzero(b.doc[at[:len(low)]] == b.doc[at[w - 1:]])
    return at[full], low[full]


def _windows(b: Block, k: int, window: int, short: list[int]) -> Iterator[tuple]:
    """(length, first words, fingerprints): all windows, and all runs of the short items' lengths."""
    words = b.word_hashes()
    yield (window, *winnow(b, words, k, window))
    for m in short:
        yield (m, *b.gram_hashes(words + np.uint64(m), m))


def _digest(b: Block, first: int, n: int) -> bytes:
    """128 bits of the words ``first .. first + n - 1``."""
    parts = [b.data[i:j].tobytes() for i, j in zip(b.starts[first:first + n].tolist(), b.ends[first:first + n].tolist())]
    return hashlib.blake2b(b" ".join(parts), digest_size=16).digest()


def _item_words(benchmark: DataFrame) -> DataFrame:
    """item_id (text) and words (joined by a space) of the items that have words."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = [], []
            for b in blocks(batch.column(1), ALNUM_WORD, lower=True):
                for i in range(b.n):
                    lo, hi = b.word_bounds[i], b.word_bounds[i + 1]
                    words.append(b" ".join([b.data[b.starts[j]:b.ends[j]].tobytes() for j in range(lo, hi)]).decode())
                    n.append(int(hi - lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string()), pa.array(n, pa.int64())],
                                             ["item_id", "words", "n"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return items.mapInArrow(split, "item_id string, words string, n long").filter("n > 0")


def _class_windows(classes: DataFrame, k: int, window: int) -> DataFrame:
    """class, hash, window of every window of each class."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), ALNUM_WORD, lower=True):
                n = np.diff(b.word_bounds)
                for length, at, hs in _windows(b, k, window, sorted({int(x) for x in n if x < window})):
                    doc = b.doc[at]
                    own = np.flatnonzero((n[doc] == length) | (length == window))     # a short item: its whole text
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(b.first + doc[own])), pa.array(hs[own].view(np.int64)),
                        pa.array([_digest(b, i, length) for i in at[own].tolist()], pa.binary())], ["class", "hash", "window"])

    return classes.mapInArrow(prints, "class string, hash long, window binary").distinct()


def _sets(prints: DataFrame) -> DataFrame:
    """hash, window, set of every distinct window; ``set`` names the classes that hold it, whatever their order."""
    number = [F.xxhash64(F.lit(i), "class") for i in range(2)]
    name = F.concat_ws(":", F.count(F.lit(1)), F.sum(number[0].cast("decimal(20,0)")), F.bit_xor(number[0]),
                       F.bit_xor(number[1]))
    return prints.groupBy("hash", "window").agg(F.unhex(F.md5(name)).alias("set"))


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """Bits ``hash mod bits`` of all fingerprints: at most bits / 64 rows reach the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = (prints.select(F.shiftright(bit, 6).alias("i"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("i").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM
                  ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, hits, sets, members).

    rows: row, doc_id, n_words of every document row; hits: row, first, last
    (words of a shared window, last exclusive), set; sets: set, class; members:
    class, item_id.
    """
    items = stage(_item_words(benchmark), "decon-items")
    members = items.select(F.sha2("words", 256).alias("class"), "item_id").distinct()
    lengths = [r["n"] for r in items.filter(F.col("n") < window).select("n").distinct().collect()]   # < window rows
    short = sorted(int(x) for x in lengths)
    classes = items.select(F.sha2("words", 256).alias("class"), "words").distinct()
    prints = stage(_class_windows(classes, k, window), "decon-prints")
    held = stage(_sets(prints), "decon-windows")
    one = held.groupBy("set").agg(F.min(F.struct("hash", "window")).alias("w")).select("set", "w.*")
    sets = stage(one.join(prints, ["hash", "window"]).select("set", "class"), "decon-sets")
    n_held = held.count()
    bits = min(BITMAP_BITS, max(LEAST_BITS, 1 << (64 * n_held).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(held, bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            n_words, found = [], []
            for b in blocks(batch.column(2), ALNUM_WORD, lower=True):
                n_words.append(np.diff(b.word_bounds))
                per_doc: list[list[dict]] = [[] for _ in range(b.n)]
                for length, at, hs in _windows(b, k, window, short):
                    hit = np.flatnonzero(_has(bitmap, hs))
                    for first, g in zip(at[hit].tolist(), hs[hit].view(np.int64).tolist()):
                        doc = b.doc[first]
                        per_doc[doc].append({"hash": g, "window": _digest(b, first, length),
                                             "at": first - int(b.word_bounds[doc]), "n": length})
                found.extend(per_doc)
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                                              pa.array(found, pa.list_(_FOUND))], ["row", "doc_id", "n_words", "found"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scanned = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        scan, f"row long, doc_id {id_type}, n_words long, found array<struct<{_WINDOW}>>"), "decon-docs")
    cand = scanned.filter(F.size("found") > 0).select("row", F.inline("found"))
    if n_held <= BROADCAST_ROWS:
        joined = cand.join(F.broadcast(held), ["hash", "window"])
    else:                                          # a window may stand in a third of all documents
        held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = cand.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(held, ["hash", "window", "salt"])
    hits = joined.select("row", F.col("at").cast("bigint").alias("first"), (F.col("at") + F.col("n")).cast("bigint").alias("last"),
                         "set")
    return scanned.select("row", "doc_id", "n_words"), hits, sets, members


def covered(spans: Column) -> Column:
    """Words covered by an array of (first, last) runs."""
    start = F.struct(F.lit(-1).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct(
        F.greatest(a["to"], x["last"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0).cast("bigint"), x["last"] - F.greatest(a["to"], x["first"]))).alias("n")),
        lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row.

    Defined cases: a null text has no words; an item without words has no window;
    items with equal ids count once, a null id as the empty string; repeated
    document rows give a row each; an empty benchmark leaves every row clean, an
    empty table gives no row; texts of any length are read whole; other columns of
    any name are not read.
    """
    rows, hits, sets, members = find_overlaps(docs, benchmark, window, k)
    per_row = stage(hits.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"),
                                            F.sort_array(F.collect_set("set")).alias("sets"))
                    .select("row", covered(F.col("spans")).alias("n_hit"), "sets",
                            F.sha2(F.array_join(F.transform("sets", F.hex), ","), 256).alias("union")), "decon-hits")
    unions = per_row.groupBy("union").agg(F.first("sets").alias("sets"))
    ids = (unions.select("union", F.explode("sets").alias("set")).join(sets, "set").select("union", "class").distinct()
           .join(members, "class").groupBy("union").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
           .select("union", F.size("ids").cast("bigint").alias("n_items"),
                   F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256")))
    flagged = per_row.select("row", "n_hit", "union").join(ids, "union")
    none = F.lit(0).cast("bigint")
    out = rows.join(flagged, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, unchanged.

    The verdict depends on the text alone, so the texts' SHA-256 are what is taken out; texts stay in the scan.
    Null and empty texts stay, repeated rows share their verdict, extra columns of any name pass through.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    bad = decontaminate(docs.select(digest.alias("doc_id"), "text"), benchmark, window, k).filter("contaminated")
    return without(docs, digest, stage(bad.select(F.col("doc_id").alias("key")).distinct(), "decon-gone"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
m AS (SELECT *, least(len(words), 13) AS n FROM i WHERE len(words) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(words[p:p + n - 1], ' ') AS w
       FROM (SELECT item_id, n, words, unnest(range(1, len(words) - n + 2)) AS p FROM m)),
dw AS (SELECT row, p, n, array_to_string(words[p:p + n - 1], ' ') AS w
       FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS p
             FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT row, p, n, item_id FROM dw JOIN iw USING (n, w)),
c AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM h) GROUP BY row),
s AS (SELECT row, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN s USING (row)
"""
