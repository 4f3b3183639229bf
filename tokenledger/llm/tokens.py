"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier 1: a table of frequent pre-tokens and their token counts, built from a
bounded sample of documents (``SAMPLE_DOCS``, ``TABLE_SIZE``) and broadcast.
Tier 2: a miss is encoded by the tokenizer library itself and kept in the
worker's cache, which is emptied when it reaches ``CACHE_SIZE`` entries; a
pre-token of more than ``CACHE_CHARS`` characters is encoded each time, so table
and cache are bounded in bytes. The sample only decides which look-ups are fast, never a result.

A byte-level BPE token never crosses a pre-token, so a text's count is the sum
over its pre-tokens. The splitting pattern is applied here only to texts whose
characters it classifies as the library does (ASCII and the Latin blocks, a
tested range); any other text is encoded whole by the library.

Defined cases: a null or empty text has 0 bytes and 0 tokens; special strings
inside a text count as the library's default treats them (one token); texts are
never cut; every input row gives one output row, an empty table none; other columns
of any name are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.samples import some_texts

SAMPLE_DOCS = 2_000
TABLE_SIZE = 1 << 16
CACHE_SIZE = 1 << 18
CACHE_CHARS = 64

#: FIXED VALUES: the byte-level pre-token pattern of the vocabulary, and the same for ASCII texts
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKEN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"

_LATIN = regex.compile(PRETOKEN)
_ASCII = re.compile(PRETOKEN_ASCII)
#: control characters that the engines class differently, and all beyond Latin Extended-B
_OTHER = re.compile("[\x1c-\x1f\x85ɐ-\U0010ffff]")


class Counter2:
    """Token counts of texts in one worker: broadcast table, cache, library."""

    def __init__(self, tokenizer_json: str, table: dict[str, int]) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        encode, base = self.tokenizer.encode, table

        class Lengths(dict):
            def __missing__(self, piece: str) -> int:
                n = len(encode(piece, add_special_tokens=False).ids)
                if len(piece) > CACHE_CHARS:
                    return n
                if len(self) >= len(base) + CACHE_SIZE:
                    self.clear()
                    self.update(base)
                self[piece] = n
                return n

        self.lengths = Lengths(base)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens of a text without special strings; None: the library must split it."""
        if _OTHER.search(text):
            return None
        return (_ASCII if text.isascii() else _LATIN).findall(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        extra, parts = 0, [text]
        if self.split is not None and self.split.search(text):
            parts = self.split.split(text)
            extra = len(parts) - 1
        total = extra
        for part in parts:
            found = self.pieces(part) if part else []
            total += self.whole(part) if found is None else sum(map(self.lengths.__getitem__, found))
        return total


_WORKER: dict[object, Counter2] = {}


def _counter(key: object, tokenizer_json: str, table: dict[str, int]) -> Counter2:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Counter2(tokenizer_json, table)
    return _WORKER[key]


def frequent_lengths(texts: list[str], tokenizer_json: str, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of the ``table_size`` most frequent pre-tokens of some texts."""
    counter, seen = Counter2(tokenizer_json, {}), Counter()
    for text in texts:
        seen.update(p for p in counter.pieces(text) or () if len(p) <= CACHE_CHARS)
    return {piece: counter.whole(piece) for piece, _ in seen.most_common(table_size)}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, sample_docs: int = SAMPLE_DOCS,
                 table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    with open(tokenizer_path, encoding="utf-8") as f:      # read by the driver; tasks get the text
        tokenizer_json = f.read()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sc = docs.sparkSession.sparkContext
    table = frequent_lengths(some_texts(docs, sample_docs), tokenizer_json, table_size)
    shared = sc.broadcast((tokenizer_json, table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter((sc_id, shared_id), *shared.value)
        for batch in batches:
            n = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    sc_id, shared_id = sc.applicationId, id(shared)
    del sc
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = (docs.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
               .mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
