"""Quality rules as a short-circuit cascade.

Every document gets the base counts (whole texts, exact). Documents that pass
the base rule then go through further rules in turn, and a document stops at the
first that rejects it. The order is found on a sample of ``SAMPLE_DOCS`` rows:
each rule's cost (seconds a document) and selectivity (share rejected) are
measured there, and rules run by falling rejection per cost. ``kept`` is the
conjunction of all rules, so the order changes the work and never a result.

Defined cases: a null or empty text has no words and fails the base rule; every
input row, repeated ones too, gives one output row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.samples import some_texts
from tokenledger.llm.textblocks import SPACE_WORD, Block, blocks

SAMPLE_DOCS = 500
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[0x80:] = 1
_UPPER = bytes(range(65, 91))


@dataclass
class Doc:
    """What a rule may look at: base counts, and the raw text."""
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_letter_words: int
    text: bytes


def _lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip(_BLANK)]


def _repeated_bigram(d: Doc) -> bool:
    words = d.text.split()
    if len(words) < 2:
        return False
    pairs: dict[tuple[bytes, bytes], int] = {}
    for p in zip(words, words[1:]):
        pairs[p] = pairs.get(p, 0) + 1
    return 10 * max(pairs.values()) > 3 * len(words)


#: name -> rejects? Limits in the manner of published web-text filters, in plain integers.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "word_length": lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words,
    "letterless_words": lambda d: 10 * d.n_letter_words < 6 * d.n_words,
    "duplicate_lines": lambda d: 2 * d.n_dup_lines > len(_lines(d.text)),
    "upper_case": lambda d: 2 * sum(map(d.text.count, (bytes([c]) for c in _UPPER))) > d.word_chars,
    "exclamations": lambda d: 5 * d.text.count(b"!") > d.n_words,
    "ellipsis_lines": lambda d: 10 * sum(x.rstrip(_BLANK).endswith((b"...", "…".encode()))
                                         for x in _lines(d.text)) > 3 * len(_lines(d.text)),
    "bullet_lines": lambda d: 10 * sum(x.lstrip(_BLANK).startswith((b"- ", b"* ", "•".encode()))
                                       for x in _lines(d.text)) > 9 * len(_lines(d.text)),
    "repeated_bigram": _repeated_bigram,
}


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    p = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=p[1:])
    return p[bounds[1:]] - p[bounds[:-1]]


def repeated_words(b: Block, words: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text: words inside a k-word window that occurs at least twice in it."""
    at, h = b.gram_hashes(words, k)
    marks = np.zeros(len(words) + 1, np.int64)
    if len(at):
        order = np.lexsort((h, b.doc[at]))
        hs, ds = h[order], b.doc[at][order]
        same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        first = at[order[twice]]
        np.add.at(marks, first, 1)
        np.add.at(marks, first + k, -1)
    return _sums(np.cumsum(marks)[:-1] > 0, b.word_bounds)


def _docs(b: Block) -> list[Doc]:
    n_words = np.diff(b.word_bounds)
    points = (b.data & 0xC0) != 0x80
    chars = _sums(points & SPACE_WORD[b.data], b.bounds)
    symbols = _sums(_SYMBOL[b.data], b.bounds)
    letters = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_LETTER[b.data], out=letters[1:])
    lettered = _sums(letters[b.ends] > letters[b.starts], b.word_bounds)
    repeats = repeated_words(b, b.word_hashes())
    out = []
    for i in range(b.n):
        text = b.text(i)
        lines = _lines(text)
        out.append(Doc(int(n_words[i]), int(chars[i]), int(symbols[i]), len(lines) - len(set(lines)),
                       int(repeats[i]), int(lettered[i]), text))
    return out


def base_failed(d: Doc) -> bool:
    return d.n_words < MIN_WORDS or 100 * d.n_repeat_words > REPEAT_PERCENT * d.n_words


def rule_order(texts: list[str], rules: dict[str, Callable[[Doc], bool]] | None = None) -> list[str]:
    """Rule names by falling rejection per cost, both measured on some texts."""
    rules = RULES if rules is None else rules
    spent, hit = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
    for b in blocks(pa.array(texts, pa.string()), SPACE_WORD):
        for d in _docs(b):
            if base_failed(d):
                continue
            for name, rejects in rules.items():
                t = time.perf_counter()
                hit[name] += rejects(d)
                spent[name] += time.perf_counter() - t
    return sorted(rules, key=lambda r: (hit[r] / max(spent[r], 1e-9), -spent[r]), reverse=True)


def quality_cascade(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, base counts, base_failed and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = rule_order(some_texts(docs, SAMPLE_DOCS)) if order is None else order
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[r] for r in order]
        for batch in batches:
            rows: list[tuple] = []
            for b in blocks(batch.column(1), SPACE_WORD):
                for d in _docs(b):
                    failed = base_failed(d)
                    kept = not failed and not any(rejects(d) for rejects in rules)
                    rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.bool_()) for c in cols[5:]]],
                ["doc_id", *names, "base_failed", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return docs.mapInArrow(judge, schema)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT row, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
      FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
r AS (SELECT row, p FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
n AS (SELECT row, count(DISTINCT q) AS n FROM (SELECT row, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY row),
b AS (SELECT row, max(c) AS top FROM (SELECT row, count(*) AS c FROM (
          SELECT row, w[p] || ' ' || w[p + 1] AS g FROM (SELECT row, w, unnest(range(1, len(w))) AS p FROM d))
      GROUP BY row, g) GROUP BY row),
s AS (SELECT d.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n.n, 0)::BIGINT AS n_repeat_words, coalesce(b.top, 0) AS top
      FROM d LEFT JOIN n USING (row) LEFT JOIN b USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) < 6 * n_words
            OR 2 * n_dup_lines > len(l) OR 2 * len(regexp_extract_all(t, '[A-Z]')) > word_chars
            OR 5 * len(regexp_extract_all(t, '!')) > n_words
            OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(l)
            OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(- |\* |•)'))) > 9 * len(l)
            OR 10 * top > 3 * n_words) AS kept
FROM f
"""
