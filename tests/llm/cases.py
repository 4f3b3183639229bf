"""Edge documents shared by the operator tests, and the brute-force word rules."""

import re

SPACE_WORD = re.compile("[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


#: (doc_id, text, lang, source, n_chars): nulls in every column, empty and blank texts, one word, repeated rows,
#: equal ids with different texts, long texts, odd characters
EDGE_DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45),
    (1, "other words under the same id", "en", "b", 29),
    (2, None, "en", "a", None), (3, "", "en", "a", 0), (4, " \t\n\x0b ", None, None, 5),
    (None, "a text without an id", "en", "a", 20), (None, None, None, None, None),
    (5, "one", "en", "b", 3), (6, "Éé ñ ß x y 中文 word\x1cword \U0001f600 z", "xx", "é", 30),
    (7, "word " * 5000, "en", "b", 25000), (8, "x" * 100_000, "en", "b", 100_000),
    (9, "line one here\nline one here\n\nline one here\r\nLINE ONE here", "en", "c", 60),
    (10, "a  b   c\n\n\n d \t e'll don't it's 12345 67 $$ ### <|endoftext|> tail <|endoftext|>", "en", "c", 70),
    (11, "alpha beta gamma delta epsilon zeta eta thetA", "en", "c", 45),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    return spark.createDataFrame(EDGE_DOCS, SCHEMA)


def clashing(df):
    """The same rows with extra columns named like those that the operators make."""
    from pyspark.sql import functions as F
    for c in ("row", "size", "target", "taken", "score", "key", "hash", "fingerprint", "n_words", "kept", "class", "found",
              "rest", "whole", "cut_key", "_source", "_size", "source_size", "candidates", "_row", "_live", "live", "_owner",
              "owner", "repository", "fp", "root", "low", "grams", "spans", "label", "held_out", "_digest", "digest", "block",
              "serial", "wins", "count", "words", "n", "value", "range", "before", "upto", "a.b", "c0", "c1"):
        df = df.withColumn(c, F.lit("x"))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
