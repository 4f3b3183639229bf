"""Semantic cache operators.

The cache index is one ordered list of (response_id, embedding); responses live
separately with a 1-hour lifetime. At read time:

* W5 -- the whole index expires 7 days after its last write (each write renews
  it); a write after expiry starts a fresh index.
* W4 -- only the last 500 appended entries are kept.
* V2 -- a prompt matches the entry with the highest cosine similarity >= 0.95;
  on equal similarity the earliest entry wins; null/empty embeddings are skipped.
* J5/W6 -- the matched response must still be alive, otherwise it is a miss
  (even if the second-best entry's response is alive).

Because W4 caps the index at 500 entries, the matcher may hand the retained
index to every task (checked: at most ``max_index_rows`` rows, else an error)
and score whole Arrow batches of prompts against it with one matrix product.

V4 (how many calls a cache could have saved) compares every request with the
requests of the previous hour. Exact, without a single task holding an hour:
time is cut into slots of window / k, a slot into the cells of some pivots, and
a cell into blocks of about ``block_rows`` rows; a request is compared only with
cells that can hold a match. A pair unit is one query block and one entry block
of a cell in the same or one of the k previous slots, keyed by both block ids, so
a busy slot's pairs spread over many tasks. Each pair is scored with a matrix product that
emits only its best candidate per request; a ``max_by`` per request then keeps
the overall best.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from pyspark.sql.pandas.types import to_arrow_schema

from tokenledger import constants as K
from tokenledger.functions.timeutil import ts_lit
from tokenledger.operators.dimensions import lookup_join
from tokenledger.operators.sequences import floor_div, global_positions, last_k_per_key

US = 1_000_000


# ------------------------------------------------------------------ kernels
def cosine_matrix(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """V1 for all pairs of two blocks: dot / (|q| |e| + 1e-9), in double."""
    dots = q @ e.T
    return dots / (np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(e, axis=1)) + K.SIMILARITY_EPS)


def _pair_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """V1 row by row. Each value depends on its two vectors only, so equal vectors tie exactly,
    whatever block they were scored in (a matrix product rounds by its shape)."""
    dots, na, nb = ((x * y).sum(axis=1) for x, y in ((a, b), (a, a), (b, b)))
    return dots / (np.sqrt(na) * np.sqrt(nb) + K.SIMILARITY_EPS)


#: scores within this much of a row's best are compared again, pair by pair
_NEAR = 1e-9


def best_in_block(q: np.ndarray, e: np.ndarray, threshold: float, allowed: np.ndarray | None = None):
    """Per row of ``q``: (position of the best entry of ``e`` with sim >= threshold,
    sim), first position on ties; -1 when none. ``e`` rows are in entry order."""
    pos, best = np.full(len(q), -1, dtype=np.int64), np.zeros(len(q))
    if len(e) == 0 or len(q) == 0:
        return pos, best
    s = cosine_matrix(q, e)
    if allowed is not None:
        s = np.where(allowed, s, -np.inf)
    top = s.max(axis=1)
    rows = np.flatnonzero(top >= threshold - _NEAR)
    near = s[rows] >= top[rows, None] - _NEAR
    pos[rows] = near.argmax(axis=1)                  # first of them
    best[rows] = _pair_cosine(q[rows], e[pos[rows]])
    for r, n in zip(rows[near.sum(axis=1) > 1].tolist(), near[near.sum(axis=1) > 1]):
        at = np.flatnonzero(n)
        exact = _pair_cosine(np.broadcast_to(q[r], (len(at), q.shape[1])), e[at])
        i = int(exact.argmax())                      # first maximum
        pos[r], best[r] = at[i], exact[i]
    hit = (pos >= 0) & (best >= threshold)
    return np.where(hit, pos, -1), np.where(hit, best, 0.0)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector, their matrix) of an Arrow list column, without a Python object a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ok = pc.fill_null(pc.greater(pc.list_value_length(column), 0), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return ok, flat.reshape(int(ok.sum()), -1) if ok.any() else np.zeros((0, 0))


# ------------------------------------------------------------------ W4, W5
def retained_index(index: DataFrame, as_of, max_entries: int = K.MAX_INDEX_ENTRIES,
                   index_ttl_s: int = K.INDEX_TTL_SECONDS, seq: str = "seq", ts: str = "inserted_at",
                   partition_cols=()) -> DataFrame:
    """The index as a reader sees it at ``as_of``.

    Writes after ``as_of`` are ignored. The index is rebuilt from empty by the
    first write at least ``index_ttl_s`` after the previous one (W5 session);
    it is empty when ``as_of`` is ``index_ttl_s`` or more after the last write;
    and only the last ``max_entries`` entries are kept (W4). With
    ``partition_cols`` (e.g. ``["tenant_id"]``) each key has its own index.

    No row-level window over a key: two writes in one ``index_ttl_s``-wide time
    bucket are less than the ttl apart, so a session break can only fall
    between buckets, and a per-(key, bucket) summary (partial aggregate, one
    row per bucket) finds the session start. W4 is ``last_k_per_key``.
    """
    pc = list(partition_cols)
    keys = pc or ["_k"]
    ttl_us = int(index_ttl_s * US)
    as_of_ts = ts_lit(as_of)
    live = index.filter(F.col(ts) <= as_of_ts)
    if not pc:
        live = live.withColumn("_k", F.lit(0))
    live = live.withColumn("_ts_us", F.unix_micros(F.col(ts)))
    pos = F.struct(F.col("_ts_us"), F.col(seq))
    b = live.groupBy(*keys, floor_div(F.col("_ts_us"), ttl_us).alias("_b")).agg(
        F.min(pos).alias("_first"), F.max("_ts_us").alias("_last"))
    b = b.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
    brk = F.col("_prev").isNull() | (F.col("_first._ts_us") - F.col("_prev") >= ttl_us)
    bounds = (b.groupBy(*keys).agg(F.max(F.when(brk, F.col("_first"))).alias("_start"),
                                   F.max("_last").alias("_end"))
               .filter(F.unix_micros(as_of_ts) < F.col("_end") + ttl_us)
               .select(*keys, "_start"))
    # one row per key: a literal single row without keys, else size-probed
    cur = lookup_join(live, bounds, keys, "inner")
    cur = cur.filter(pos >= F.col("_start")).drop("_start", "_ts_us")
    # without keys at most max_entries ranges survive the summary filter
    kept = last_k_per_key(cur, keys, seq, max_entries)
    return kept if pc else kept.drop("_k")


# ------------------------------------------------------------------ V2, J4
MAX_SHIPPED_VALUES = 16_000_000   # whole retained index shipped to tasks up to 16M doubles (128 MB)
MAX_HOT_KEYS = 100_000
GROUP_BYTES = 64 * 1024 * 1024    # vectors of one cogrouped task group


def _entry_block(ids: pa.Array, seqs: pa.Array, vectors: pa.Array):
    """(ids, seqs, matrix) of one index, in seq order (ties keep the earliest)."""
    order = np.argsort(seqs.to_numpy(zero_copy_only=False), kind="stable")
    _, m = _matrix(vectors)
    return [ids[int(i)].as_py() for i in order], seqs.to_numpy(zero_copy_only=False)[order], m[order]


def _blocks(rows: pa.Table, keys: list[str], max_index_rows: int) -> dict:
    """Entry blocks by key of a collected index."""
    rows = rows.combine_chunks()
    by: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*[rows.column(k).to_pylist() for k in keys]) if keys else [()] * rows.num_rows):
        by.setdefault(key, []).append(i)
    out = {}
    for key, at in by.items():
        if len(at) > max_index_rows:
            raise ValueError(f"index of key {key} has more than {max_index_rows} entries; "
                             "apply retained_index(partition_cols=...) first")
        part = rows.take(pa.array(at)).combine_chunks()
        out[key] = _entry_block(*[part.column(c).combine_chunks() for c in ("response_id", "seq", "embedding")])
    return out


def _scorer(spark, blocks: dict, qid: str, qvec: str, keys: list[str], threshold: float):
    """A ``mapInArrow`` function that scores query batches against a shipped index."""
    shared = spark.sparkContext.broadcast(blocks)

    def score(batches):
        for batch in batches:
            yield _match_batch(batch, qid, qvec, shared.value, keys, threshold)
    return score


_EMPTY_BLOCK = ([], np.zeros(0, dtype=np.int64), np.zeros((0, 0)))


def _match(ok: np.ndarray, q: np.ndarray, block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``block`` or -1, similarity) of every query row (one matrix product)."""
    pos, sim = np.full(len(ok), -1, dtype=np.int64), np.zeros(len(ok))
    if ok.any() and len(block[0]):
        pos[ok], sim[ok] = best_in_block(q, block[2], threshold)
    return pos, sim


def _match_columns(pos: np.ndarray, sim: np.ndarray, ids: list, seqs: list) -> list[pa.Array]:
    hit = pos >= 0
    return [pa.array(ids, pa.string()), pa.array(seqs, pa.int64()), pa.array(np.where(hit, sim, 0.0), mask=~hit)]


def _match_batch(batch: pa.RecordBatch, qid: str, qvec: str, blocks: dict, keys: list[str], threshold: float
                 ) -> pa.RecordBatch:
    """Best entry per query row; each key's rows are scored against that key's block."""
    ok, q = _matrix(batch.column(qvec))
    pos, sim = np.full(len(ok), -1, dtype=np.int64), np.zeros(len(ok))
    ids, seqs = np.full(len(ok), None, dtype=object), np.full(len(ok), None, dtype=object)
    row_of = np.cumsum(ok) - 1
    code = np.zeros(len(ok), dtype=np.int64)
    for k in keys:
        c = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        code = code * (int(c.max(initial=0)) + 1) + c
    for value in np.unique(code):
        at = np.flatnonzero(code == value)
        block = blocks.get(tuple(batch.column(k)[int(at[0])].as_py() for k in keys), _EMPTY_BLOCK)
        p, s = _match(ok[at], q[row_of[at[ok[at]]]] if ok[at].any() else q[:0], block, threshold)
        pos[at], sim[at] = p, s
        for i, j in zip(at[p >= 0].tolist(), p[p >= 0].tolist()):
            ids[i], seqs[i] = block[0][j], int(block[1][j])
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column(qid),
                                       *_match_columns(pos, sim, ids.tolist(), seqs.tolist())],
                                      [*keys, qid, "response_id", "seq", "sim"])


def best_match(queries: DataFrame, index: DataFrame, qid: str = "query_id", qvec: str = "embedding",
               threshold: float = K.SIMILARITY_THRESHOLD, max_index_rows: int = K.MAX_INDEX_ENTRIES,
               partition_cols=(), max_shipped_values: int = MAX_SHIPPED_VALUES,
               group_rows: int = 200_000) -> DataFrame:
    """Per query, the best retained entry with sim >= threshold.

    ``index`` (response_id, seq, embedding) must be the retained index (W4 caps
    it at ``max_index_rows`` entries, per key with ``partition_cols``). Output:
    [partition_cols], qid, response_id (null on no match), seq, sim.

    Without ``partition_cols`` (the reference: one global index) the index is
    checked to hold at most ``max_index_rows`` rows and shipped to the tasks;
    each Arrow batch of queries is scored with one matrix product.

    With ``partition_cols`` (per-tenant isolation) a query only sees its own
    key's index; entries or queries with a null key match nothing. The whole
    retained index is shipped when one aggregate shows entries x width of
    at most ``max_shipped_values`` doubles; otherwise each key's index is packed into
    one row (at most ``max_index_rows`` entries) and cogrouped with the queries
    on (key, salt): keys with more than ``group_rows`` queries get
    ceil(n / group_rows) salts and their packed index is copied once per salt,
    so no group holds more than about ``group_rows`` queries, or 64 MB of vectors.
    """
    spark = queries.sparkSession
    pc = list(partition_cols)
    idx = index.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)) \
               .select(*pc, "response_id", "seq", F.col("embedding").cast("array<double>").alias("embedding"))
    qid_type = queries.schema[qid].dataType
    fields = [queries.schema[c] for c in pc] + [
        StructField(qid, qid_type), StructField("response_id", StringType()),
        StructField("seq", LongType()), StructField("sim", DoubleType())]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    q = queries.select(*pc, qid, F.col(qvec).cast("array<double>").alias(qvec))

    if not pc:
        rows = idx.orderBy("seq").limit(max_index_rows + 1).toArrow()
        if rows.num_rows > max_index_rows:
            raise ValueError(f"index has more than {max_index_rows} entries; apply retained_index() first")
        return q.mapInArrow(_scorer(spark, _blocks(rows, [], max_index_rows), qid, qvec, [], threshold), schema)

    for c in pc:
        idx = idx.filter(F.col(c).isNotNull())
    # one aggregate gives the shipped size: entries x vector width (in doubles);
    # the retained index is kept for the size check and the collect only
    idx = idx.persist()
    n_entries, width = idx.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n_entries * (width or 0) <= max_shipped_values:
        rows = idx.toArrow()                                    # bounded by max_shipped_values
        idx.unpersist()
        return q.mapInArrow(_scorer(spark, _blocks(rows, pc, max_index_rows), qid, qvec, pc, threshold), schema)

    # shuffle path: salted cogroup of queries with packed per-key indexes (the
    # plan below is lazy, so the cached copy is released rather than pinned)
    idx.unpersist()
    group_rows = max(1, min(group_rows, GROUP_BYTES // (8 * max(1, width))))
    counts = q.groupBy(*pc).agg(F.count(F.lit(1)).alias("_n"))
    hot = (counts.filter(F.col("_n") > group_rows)
           .select(*pc, F.ceil(F.col("_n") / group_rows).cast("int").alias("_ns"))
           .limit(MAX_HOT_KEYS + 1).collect())
    if len(hot) <= MAX_HOT_KEYS:
        salts = spark.createDataFrame(hot, StructType([queries.schema[c] for c in pc]
                                                      + [StructField("_ns", IntegerType())]))
        q = lookup_join(q, salts, pc, "left")
        packed_ns = lambda df: lookup_join(df, salts, pc, "left")
    else:       # too many hot keys to list: one salt count for every key
        top = counts.agg(F.max("_n")).first()[0]
        ns = max(1, math.ceil(top / group_rows))
        q = q.withColumn("_ns", F.lit(ns))
        packed_ns = lambda df: df.withColumn("_ns", F.lit(ns))
    q = q.withColumn("_salt", F.pmod(F.xxhash64(qid), F.coalesce(F.col("_ns"), F.lit(1)))).drop("_ns")
    packed = packed_ns(idx.groupBy(*pc).agg(F.collect_list(F.struct("response_id", "seq", "embedding"))
                                            .alias("_entries")))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_ns"), F.lit(1)) - 1)))
    packed = packed.drop("_ns")

    def score_group(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = {}
        if right.num_rows and left.num_rows:
            entries = right.column("_entries").combine_chunks().flatten()
            if len(entries) > max_index_rows:
                raise ValueError(f"an index key has more than {max_index_rows} entries; "
                                 "apply retained_index(partition_cols=...) first")
            key = tuple(left.column(c)[0].as_py() for c in pc)
            blocks[key] = _entry_block(*[entries.field(f) for f in ("response_id", "seq", "embedding")])
        batches = [_match_batch(b, qid, qvec, blocks, pc, threshold) for b in left.to_batches() if b.num_rows]
        return pa.Table.from_batches(batches) if batches else to_arrow_schema(schema).empty_table()

    return (q.groupBy(*pc, "_salt").cogroup(packed.groupBy(*pc, "_salt"))
            .applyInArrow(score_group, schema))


# ------------------------------------------------------------------ J5, W6
def lookup_responses(matches: DataFrame, responses: DataFrame, as_of,
                     ttl_s: int = K.RESPONSE_TTL_SECONDS) -> DataFrame:
    """J5 + W6: attach the matched response if it is still alive at ``as_of``;
    a dead response is a miss. ``responses`` (response_id, value, written_at);
    only responses written in the last ``ttl_s`` can be alive, so that filter
    runs before the join and bounds the right side."""
    as_of_ts = ts_lit(as_of)
    alive = (responses.filter((F.col("written_at") <= as_of_ts)
                              & (as_of_ts < F.col("written_at") + F.make_dt_interval(secs=F.lit(ttl_s))))
             .select("response_id", F.col("value").alias("response"), F.lit(True).alias("_alive")))
    out = matches.join(alive, "response_id", "left")
    return out.withColumn("hit", F.coalesce(F.col("_alive"), F.lit(False))).drop("_alive")


# ------------------------------------------------------------------ V3
def append_entries(index: DataFrame, new: DataFrame, id_col: str = "request_id") -> DataFrame:
    """V3: append (response_id, embedding) for newly cached responses.

    ``seq`` continues after the current maximum in (inserted_at, id) order. The
    numbering is a range-partitioned sort plus per-partition offsets
    (``global_positions``), so no single task numbers the rows. The response id
    is derived from the request id so reruns are idempotent.
    """
    base = index.agg(F.max("seq")).first()[0]
    base = -1 if base is None else int(base)
    fresh = new.select(F.concat(F.lit("r"), F.sha2(F.col(id_col).cast("string"), 256)).alias("response_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                       "inserted_at", id_col)
    ranked = global_positions(fresh, ["inserted_at", id_col])
    fresh = ranked.select("response_id", "embedding", "inserted_at", (F.lit(base) + F.col("_pos")).alias("seq"))
    return index.select("response_id", "embedding", "inserted_at", "seq").unionByName(fresh)


# ------------------------------------------------------------------ V4
MAX_PIVOTS = 256


def _cells(pivots: np.ndarray, radius: float):
    """A ``mapInArrow`` function adding ``home`` (the nearest pivot's cell) and ``cells``: the cells that can
    hold a vector within ``radius`` of this one (its distance to the cell's bounding hyperplane says so)."""
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def fn(batches):
        for batch in batches:
            _, m = _matrix(batch.column("v"))
            size = np.linalg.norm(m, axis=1, keepdims=True)
            dots = (m / np.where(size > 0, size, 1)) @ pivots.T
            home = dots.argmax(axis=1)
            reach = dots[np.arange(len(m)), home][:, None] - dots <= (radius + 1e-6) * gap[home] + 1e-9
            reach[np.arange(len(m)), home] = True
            row, cell = np.nonzero(reach)
            bounds = np.append(0, np.cumsum(reach.sum(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cell.astype(np.int32)))],
                [*batch.schema.names, "home", "cells"])
    return fn


def assign_cells(r: DataFrame, n_pivots: int, threshold: float) -> DataFrame:
    """Rows (id, t, h, v) with ``home`` and ``cells``, staged once in the shared folder.

    The pivots are ``n_pivots`` vectors by id hash (at most MAX_PIVOTS reach the driver). Similarity of at least
    ``threshold`` means a distance of at most sqrt(2 - 2 threshold) on unit vectors, so no pair is lost; zero
    vectors match nothing.
    """
    rows = r.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").toArrow()
    _, pivots = _matrix(rows.column("v"))
    size = np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = np.unique((pivots / np.where(size > 0, size, 1))[size[:, 0] > 0], axis=0)
    if len(pivots) < 2 or threshold <= 0:
        return r.withColumns({"home": F.lit(0), "cells": F.array(F.lit(0))}).checkpoint()
    schema = StructType([*r.schema.fields, StructField("home", IntegerType()), StructField("cells", ArrayType(IntegerType()))])
    return r.mapInArrow(_cells(pivots, math.sqrt(max(0.0, 2 - 2 * threshold))), schema).checkpoint()


def _pack(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(h, c, b) blocks of rows as flat columns, from one sorted list (so they stay aligned)."""
    return (lookup_join(rows, blocks, ["h", "c"], "inner")
            .withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
            .groupBy("h", "c", "b").agg(F.array_sort(F.collect_list(F.struct("t", "id", "v"))).alias("_rows"))
            .select("h", "c", "b", F.transform("_rows", lambda x: x["id"]).alias("ids"),
                    F.transform("_rows", lambda x: x["t"]).alias("ts"),
                    F.flatten(F.transform("_rows", lambda x: x["v"])).alias("flat")))


def similar_earlier(requests: DataFrame, id_col: str = "request_id", ts: str = "ts", vec: str = "embedding",
                    window_s: int = 3600, threshold: float = K.SIMILARITY_THRESHOLD,
                    block_rows: int = 2048, slots_per_window: int | None = None,
                    n_pivots: int | None = None) -> DataFrame:
    """V4: per request, the most similar earlier request within ``window_s``
    (sim >= threshold; ties -> earliest). Output: id, match_id, match_sim.

    Time is cut into slots of ceil(window / k): a request's partners lie in its
    own and the k previous slots, so k + 1 slot widths are compared instead of
    two windows. ``k`` (``slots_per_window``) defaults to the densest window's
    rows / ``block_rows`` (1..8), so a slot still fills a block.

    Within a slot, requests lie in the cells of ``n_pivots`` pivots. Every request
    is an entry of its own cell and a query in those cells that can hold a match
    (``assign_cells``), so similar requests meet in few cells instead of with
    every block of the window; how few depends on how the vectors cluster.
    """
    id_type = requests.schema[id_col].dataType
    r = (requests.select(F.col(id_col).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
                         F.col(vec).cast("array<double>").alias("v"))
         .filter(F.col("v").isNotNull() & (F.size("v") > 0)))
    win_us = int(window_s * US)

    def densest(width: int) -> int:
        n = r.groupBy(floor_div(F.col("t"), width).alias("h")).count().agg(F.max("count")).first()[0]
        return int(n or 0)

    k = slots_per_window or int(min(8, max(1, densest(win_us) // block_rows)))
    width = -(-win_us // k)                                  # ceil: k slots cover a window
    if n_pivots is None:
        n_pivots = int(min(MAX_PIVOTS, max(1, densest(width) // block_rows)))
    r = assign_cells(r.withColumn("h", floor_div(F.col("t"), width)), n_pivots, threshold)
    queries = r.select("id", "t", "v", "h", F.explode("cells").alias("c"))
    entries = r.select("id", "t", "v", "h", F.col("home").alias("c"))

    def counted(rows: DataFrame) -> DataFrame:
        nb = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int")
        return rows.groupBy("h", "c").agg(nb.alias("nb"))

    lslots, rslots = counted(queries).checkpoint(), counted(entries).checkpoint()
    # partner cells: (query slot h, cell, its blocks, partner slot ph = h - j for j = 0..k, the partner's blocks)
    partners = (lslots.select("h", "c", F.col("nb").alias("lnb"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("j"))
                .select("h", "c", "lnb", (F.col("h") - F.col("j")).alias("ph"))
                .join(rslots.select(F.col("h").alias("ph"), "c", F.col("nb").alias("pnb")), ["ph", "c"]))
    # a pair unit is (query block, entry block of a partner cell): each side is
    # copied once per partner block and the join key names the pair, so a busy
    # slot's pairs spread over many tasks
    left = (_pack(queries, lslots).join(partners.select("h", "c", "ph", "pnb"), ["h", "c"])
            .select(F.col("h").alias("lh"), "c", F.col("b").alias("lb"), F.col("ph").alias("rh"),
                    F.explode(F.sequence(F.lit(0), F.col("pnb") - 1)).alias("rb"),
                    F.col("ids").alias("lids"), F.col("ts").alias("lts"), F.col("flat").alias("lflat")))
    right = (_pack(entries, rslots).withColumnRenamed("h", "ph")
             .join(partners.select("h", "c", "lnb", "ph"), ["ph", "c"])
             .select(F.col("h").alias("lh"), "c", F.explode(F.sequence(F.lit(0), F.col("lnb") - 1)).alias("lb"),
                     F.col("ph").alias("rh"), F.col("b").alias("rb"),
                     F.col("ids").alias("rids"), F.col("ts").alias("rts"), F.col("flat").alias("rflat")))
    pairs = left.join(right, ["lh", "c", "lb", "rh", "rb"], "inner")
    schema = StructType([StructField("id", id_type), StructField("match_id", id_type),
                         StructField("match_t", LongType()), StructField("match_sim", DoubleType())])
    arrow_id = to_arrow_schema(schema).field("id").type

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lids, lts, lflat, rids, rts, rflat = (
                    batch.column(c)[i].values for c in ("lids", "lts", "lflat", "rids", "rts", "rflat"))
                lt, rt = lts.to_numpy(zero_copy_only=False), rts.to_numpy(zero_copy_only=False)
                q = lflat.to_numpy(zero_copy_only=False).reshape(len(lt), -1)
                e = rflat.to_numpy(zero_copy_only=False).reshape(len(rt), -1)   # (t, id) order: ties keep the earliest
                # ids as places in one order of both sides, so any id type compares
                both = pa.chunked_array([lids, rids]).combine_chunks()
                place = pc.rank(both, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
                lid, rid = place[:len(lt)], place[len(lt):]
                earlier = (rt[None, :] < lt[:, None]) | ((rt[None, :] == lt[:, None]) & (rid[None, :] < lid[:, None]))
                pos, sim = best_in_block(q, e, threshold, earlier & (lt[:, None] - rt[None, :] <= win_us))
                hit = np.flatnonzero(pos >= 0)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [lids.take(pa.array(hit)).cast(arrow_id), rids.take(pa.array(pos[hit])).cast(arrow_id),
                         pa.array(rt[pos[hit]]), pa.array(sim[hit])], ["id", "match_id", "match_t", "match_sim"])

    cands = pairs.mapInArrow(score, schema)
    best = (cands.groupBy("id")
            .agg(F.max("match_sim").alias("s"),
                 F.min_by("match_id", F.struct(-F.col("match_sim"), "match_t", "match_id")).alias("match_id")))
    return (r.select("id").join(best, "id", "left")
             .select(F.col("id").alias(id_col), "match_id", F.col("s").alias("match_sim")))
