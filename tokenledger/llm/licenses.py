"""License scans by diagonal voting.

Templates are word sequences: short phrases and well-known notices. Every rolling
word k-gram hash of a document (k = 2 for phrases, 5 for notices) is joined in
Spark to the templates' hashes; the template side is a constant table and is
broadcast. A match votes for the diagonal (document position minus template
position) it lies on; votes are counted per document, template and diagonal
before they leave a task. Diagonals of a template that lie within ``SHIFT`` words
of each other and whose stretches follow each other are merged -- an inserted or
dropped word moves a copy to a neighbouring diagonal -- and the merged span is
verified: a phrase must be whole on one diagonal, a notice needs ``SHARE`` of its
k-grams, each counted once, within a bounded length.

Defined cases: a null or empty text has no words, places or labels and score 0;
every row, repeated ones and null ids too, gives one row; an empty table gives none;
a long text is one block and its places are counted in Spark, however many; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.textblocks import ALNUM_WORD, blocks

PHRASE_GRAM = 2
NOTICE_GRAM = 5
SHIFT = 4
SHARE = 0.5
#: rows whose notice hits are read at a time
JUDGED_ROWS = 512

#: FIXED VALUES: the base phrases and their labels
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: further phrases of the method
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
}

#: FIXED VALUES: opening words of public license notices
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License "
              "at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
              "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES "
              "OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation, either version 3 of the License, "
           "or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met: Redistributions of source code must retain the above copyright "
           "notice, this list of conditions and the following disclaimer",
}


def _templates() -> list[tuple[int, str, str, list[str]]]:
    """(gram length, kind, label, words)"""
    def words(text: str) -> list[str]:
        for b in blocks(pa.array([text]), ALNUM_WORD, lower=True):
            return [b.data[s:e].tobytes().decode() for s, e in zip(b.starts, b.ends)]
        return []

    return ([(PHRASE_GRAM, "base", label, words(p)) for p, label in BASE_PHRASES.items()]
            + [(PHRASE_GRAM, "phrase", label, words(p)) for p, label in PHRASES.items()]
            + [(NOTICE_GRAM, "notice", label, words(p)) for label, p in NOTICES.items()])


def template_grams(templates: list[tuple[int, str, str, list[str]]]) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every template k-gram."""
    out = []
    for t, (k, _, _, words) in enumerate(templates):
        for b in blocks(pa.array([" ".join(words)]), ALNUM_WORD, lower=True):
            at, h = b.gram_hashes(b.word_hashes(), k)
            out += [(int(x), t, int(p)) for x, p in zip(h.view(np.int64), at)]
    return out


def document_grams(docs: DataFrame, ks: tuple[int, ...] = (PHRASE_GRAM, NOTICE_GRAM)) -> DataFrame:
    """row, doc_id, n_words, grams: the hashes of all rolling k-grams, the lengths ``ks`` one after another."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2), ALNUM_WORD, lower=True):
                words = b.word_hashes()
                n = np.diff(b.word_bounds)
                found = [b.gram_hashes(words, k) for k in ks]
                # each text's grams of all lengths together, in the order of ``ks``
                doc = np.concatenate([b.doc[at] for at, _ in found])
                order = np.argsort(doc, kind="stable")
                sizes = sum(np.maximum(n - k + 1, 0) for k in ks)
                grams = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                                                 pa.array(np.concatenate([h for _, h in found])[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.n), batch.column(1).slice(b.first, b.n),
                     pa.array(n, pa.int64()), grams], ["row", "doc_id", "n_words", "grams"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        scan, f"row long, doc_id {id_type}, n_words long, grams array<long>")


def _merge(diagonals: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Chains of (diagonal, votes, first, last template position) of one template, in document order."""
    chains: list[list[tuple[int, int, int, int]]] = []
    near: list[list[tuple[int, int, int, int]]] = []          # chains that a later diagonal can still follow
    reach = 3 * NOTICE_GRAM + SHIFT
    for d in sorted(diagonals, key=lambda x: (x[0] + x[2], x[0])):
        near = [c for c in near if d[0] + d[2] <= c[-1][0] + c[-1][3] + reach]
        for chain in reversed(near):
            if abs(d[0] - chain[-1][0]) <= SHIFT and d[2] > chain[-1][2]:
                chain.append(d)
                break
        else:
            chains.append([d])
            near.append(chains[-1])
    return chains


def verify_notice(found: list[tuple[int, int, int, int]], words: int) -> tuple[float, list[tuple[int, int]]]:
    """(largest share of the notice's k-grams in one chain, verified stretches) of a notice of so many words."""
    need, score, spans = words - NOTICE_GRAM + 1, 0.0, []
    for chain in _merge(found):
        share = min(need, sum(v for _, v, _, _ in chain)) / need
        first, last = chain[0][0] + chain[0][2], max(d + hi for d, _, _, hi in chain) + NOTICE_GRAM
        score = max(score, share)
        if share >= SHARE and last - first <= 2 * words:
            spans.append((first, last))
    return score, spans


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))


def _notices(hits: pa.ListArray, templates: list[tuple[int, str, str, list[str]]]) -> list[pa.Array]:
    """mask, score and spans of each row of notice hits (template, diagonal, votes, first, last)."""
    sizes = pc.list_value_length(hits).fill_null(0).to_numpy(zero_copy_only=False)
    flat = hits.flatten()
    cols = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(5)]
    masks, scores, spans = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), {}
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes).tolist():
        t, *rest = (c[ends[i] - sizes[i]:ends[i]] for c in cols)
        for template in np.unique(t).tolist():
            at = t == template
            _, _, label, words = templates[template]
            score, places = verify_notice(list(zip(*(c[at].tolist() for c in rest))), len(words))
            scores[i] = max(scores[i], score)
            if places:
                masks[i] |= 1 << template
                spans.setdefault(i, []).extend({"first": a, "last": z, "label": label} for a, z in places)
    return [pa.array(masks), pa.array(scores), pa.array([spans.get(i, []) for i in range(len(sizes))], _SPANS)]


def scan_licenses(docs: DataFrame, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and, if asked, spans of every row.

    ``spans``: (first, last, label) of every verified place, in words, last exclusive. Phrases are decided by
    Spark's aggregates; only the diagonals of notices reach Python.
    """
    templates = _templates()
    spark = docs.sparkSession
    grams = template_grams(templates)
    table = F.broadcast(spark.createDataFrame(grams, "hash long, template int, position int"))     # constant size
    scanned = document_grams(docs)
    # posexplode_outer keeps a row for texts without grams; a text's row outlives the join as its position 0
    each = scanned.select("row", "doc_id", "n_words", F.posexplode_outer("grams").alias("at", "hash"))
    joined = each.join(table, "hash", "left").filter(F.col("template").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    n_pairs = F.greatest(F.col("n_words") - (PHRASE_GRAM - 1), F.lit(0))
    is_notice = F.col("at") >= n_pairs
    place = F.when(is_notice, F.col("at") - n_pairs).otherwise(F.col("at"))
    notice = F.array(*[F.lit(t[1] == "notice") for t in templates])
    fits = F.col("template").isNull() | (F.get(notice, F.col("template")) == is_notice)
    votes = (joined.withColumn("template", F.when(fits, F.col("template")))
             .groupBy("row", "template", F.when(F.col("template").isNotNull(), place - F.col("position")).alias("diagonal"))
             .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                  F.count(F.lit(1)).alias("votes"), F.min("position").alias("first"), F.max("position").alias("last")))

    def of_template(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))

    need = of_template([len(words) - k + 1 for k, _, _, words in templates])
    phrase = of_template([kind != "notice" for _, kind, _, _ in templates])
    base = of_template([kind == "base" for _, kind, _, _ in templates])
    diagonal = F.col("diagonal").cast("long")
    whole = phrase & (F.col("votes") == need)
    place_of_base = F.when(whole & base, diagonal)
    zero = F.lit(0).cast("long")
    found = [F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
             F.count(place_of_base).alias("n_base"), F.min(place_of_base).alias("first_word"),
             F.max(place_of_base).alias("last_word"),
             F.coalesce(F.bit_or(F.when(whole, of_template([1 << t for t in range(len(templates))]))), zero)
             .cast("long").alias("mask"),
             F.coalesce(F.max(F.when(whole, 1.0).when(phrase, F.col("votes") / need * 0.5)), F.lit(0.0)).alias("score"),
             F.collect_list(F.when(~phrase, F.struct("template", diagonal.alias("diagonal"), "votes", "first", "last"))
                            ).alias("hits")]
    if spans:
        length, label = of_template([len(t[3]) for t in templates]), of_template([t[2] for t in templates])
        found.append(F.collect_list(F.when(whole, F.struct(
            diagonal.alias("first"), (diagonal + length).alias("last"), label.alias("label")))).alias("places"))
    per_row = votes.groupBy("row").agg(*found).drop("row")
    at = per_row.columns.index("hits")
    kept = [i for i in range(len(per_row.columns)) if i != at]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, JUDGED_ROWS):
                part = batch.slice(lo, JUDGED_ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in kept], *_notices(part.column(at), templates)],
                                                 [*[batch.schema.names[i] for i in kept], *more])

    more = ["notice_mask", "notice_score", "notice_spans"]
    schema = T.StructType([per_row.schema.fields[i] for i in kept] + [
        T.StructField("notice_mask", T.LongType()), T.StructField("notice_score", T.DoubleType()),
        T.StructField("notice_spans", T.ArrayType(T.StructType([
            T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("label", T.StringType())])))])
    judged = per_row.mapInArrow(judge, schema)

    def labels(mask: Column, kinds: tuple[str, ...]) -> Column:
        each = [F.when(mask.bitwiseAND(F.lit(1 << t)) != 0, F.lit(label))
                for t, (_, kind, label, _) in enumerate(templates) if kind in kinds]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*each)))), ",")

    mask = F.col("mask").bitwiseOR(F.col("notice_mask"))
    out = ["doc_id", "n_words", "n_base", "first_word", "last_word", labels(mask, ("base",)).alias("base_labels"),
           labels(mask, ("base", "phrase", "notice")).alias("labels"), F.greatest("score", "notice_score").alias("score")]
    return judged.select(*out, *([F.array_sort(F.concat("places", "notice_spans")).alias("spans")] if spans else []))
