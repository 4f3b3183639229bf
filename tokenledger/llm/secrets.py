"""Secret scans with corpus-wide ownership frequency.

1. Every whole text is searched for candidates: the base kinds (assignments,
   access keys, long hex strings) and further credential formats. A candidate's
   value is carried as its SHA-256, never in the clear. A private key's value is
   its base64 body, whatever it is broken by (line ends, escapes, quotes), to its
   last base64 line if the END line is missing; a header without a body stands for
   itself.
2. The hashes of candidates that look random are aggregated over the corpus: first
   to one row per (hash, distinct text), so copies of a document count once, for
   its smallest (owner, repository); then to one row per (hash, owner, repository)
   and to counts per hash. Each step adds up before it shuffles.
3. A value of one owner, in at most ``MAX_REPOSITORIES`` repositories and at most
   ``MAX_TEXTS`` different texts, is live-looking: its place is added as a span of
   kind ``live``. More owners, repositories or texts make it a widely copied
   example. All base spans stay.

Defined cases: a null text is empty; a null owner or repository is one of its
own; every row, repeated ones too, gives one row; spans are in code points, end
exclusive, ordered by start and then by kind as listed in ``KINDS``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.staging import BROADCAST_KEYS, numbered, renamed, stage

MAX_REPOSITORIES = 2
MAX_TEXTS = 5
MIN_ENTROPY = 2.5
#: beyond a list of a size that is broadcast, live values are joined by shuffle in so many copies
SALTS = 16

#: FIXED VALUES: the base patterns; (kind, pattern, group that holds the value, least length)
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
#: the same runs of hex digits, found without stopping at short ones
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: formats that the method adds
MORE = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), 0, 0),
    ("github", re.compile(r"(?a)\bgh[pousr]_[A-Za-z0-9]{36,}"), 0, 0),
    ("slack", re.compile(r"(?a)\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 0),
    ("stripe", re.compile(r"(?a)\b[rs]k_live_[A-Za-z0-9]{16,}"), 0, 0),
    # a run of these characters is tried from its begin alone and never given back: linear in the text
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), 0, 0),
]
KINDS = [*[k[0] for k in BASE], *[k[0] for k in MORE], "live"]
_HINTS = ("-----BEGIN", "gh", "xox", "k_live_", "eyJ")

#: what may stand between a private key's lines: white space, escapes, quotes, comment signs, a joining plus
_BREAK = r"""(?:\\[nrt]|[\s"'`,>#*|\\]|//|(?<=[\s"'`])\+(?=\s))*+"""
_BASE64 = r"(?:[A-Za-z0-9+/=]|\\/)"
#: after a key's header: fields such as Proc-Type, lines of 16 base64 characters at least, and one shorter last line
_KEY = re.compile(rf"""(?:{_BREAK}[A-Z][A-Za-z0-9-]{{0,40}}:\x20[^\r\n\\]{{0,200}})*+{_BREAK}
    (?P<body>{_BASE64}{{16,}}+(?:{_BREAK}{_BASE64}{{16,}}+)*+
        (?:{_BREAK}{_BASE64}{{1,15}}+(?=[\x20\t]*(?:[\r\n]|\Z)|\\[nr]|["'`]|{_BREAK}-----END))?)
    (?:{_BREAK}-----END[ ][A-Z ]{{0,30}}PRIVATE[ ]KEY-----)?""", re.VERBOSE)
_NOT_BASE64 = re.compile(r"""\\[nrt]|(?<=[\s"'`])\+(?=\s)|[^A-Za-z0-9+/=]""")


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Digits and letters of more than ``MIN_ENTROPY`` bits a character."""
    return (len(value) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            and _entropy(value) >= MIN_ENTROPY)


def find(text: str) -> list[tuple[int, int, int, int, int, str, bool]]:
    """(kind, start, end, value start, value end, value hash, looks random) of the candidates of a text."""
    out = []

    def add(kind: int, m: re.Match, group: int) -> None:
        value = m[group]
        out.append((kind, m.start(), m.end(), m.start(group), m.end(group),
                    hashlib.sha256(value.encode()).hexdigest(), looks_random(value)))

    for kind, (name, pattern, group, least) in enumerate(BASE):
        if name == "access" and "AKIA" not in text:
            continue
        for m in (_LONG_HEX if name == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                add(kind, m, group)
    for kind, (_, pattern, group, _) in enumerate(MORE, len(BASE)):
        if _HINTS[kind - len(BASE)] in text:
            for m in pattern.finditer(text):
                key = _KEY.match(text, m.end()) if KINDS[kind] == "pem" else None
                if key:
                    value = _NOT_BASE64.sub("", key["body"])
                    out.append((kind, m.start(), key.end(), *key.span("body"),
                                hashlib.sha256(value.encode()).hexdigest(), looks_random(value)))
                else:
                    add(kind, m, group)
    return sorted(out)


_SPAN = "struct<kind:int,start:bigint,end:bigint,value_start:bigint,value_end:bigint,value:string,random:boolean>"
_FIELDS = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()),
           ("value_end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())]


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``candidates`` (see ``find``) and ``digest`` (SHA-256 of a text that has any) in place of its text."""
    docs = docs.drop("candidates", "digest")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct(_FIELDS))
    names = [f[0] for f in _FIELDS]
    others = [i for i in range(len(docs.columns)) if i != at]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for value in batch.column(at):                   # one text at a time
                t = value.as_py()
                some = find(t) if t else []
                found.append([dict(zip(names, c)) for c in some])
                digests.append(hashlib.sha256(t.encode()).hexdigest() if some else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in others], pa.array(found, kind), pa.array(digests, pa.string())],
                [*[batch.schema.names[i] for i in others], "candidates", "digest"])

    return docs.mapInArrow(scan, T.StructType([
        *[docs.schema.fields[i] for i in others],
        T.StructField("candidates", T.ArrayType(T._parse_datatype_string(_SPAN))), T.StructField("digest", T.StringType())]))


def ownership(rows: DataFrame) -> DataFrame:
    """value, n_owners, n_repositories, n_texts of every value that looks random.

    ``rows``: candidates, digest, owner, repository. Copies of a text are one text, held by its smallest
    (owner, repository), nulls first.
    """
    values = F.array_distinct(F.transform(F.filter("candidates", lambda c: c["random"]), lambda c: c["value"]))
    each = rows.select(F.explode(values).alias("value"), "digest", F.struct("owner", "repository").alias("holder"))
    texts = each.groupBy("value", "digest").agg(F.min("holder").alias("holder"))
    held = (texts.select("value", "holder.*").groupBy("value", "owner", "repository")
            .agg(F.count(F.lit(1)).alias("n_texts")))
    owners = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n_texts").alias("n_texts"))
    return owners.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"),
                                       F.sum("n_texts").alias("n_texts"))


def live_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """row and live (start, kind, end) of the rows of ``places`` that hold live-looking values.

    ``rows``: candidates, digest, owner, repository, which tell the live values; ``places``: row, candidates. Only live
    values are sent to the places, and only candidates that look random are joined to them.
    """
    live = stage(ownership(rows).filter((F.col("n_owners") == 1) & (F.col("n_repositories") <= MAX_REPOSITORIES)
                                        & (F.col("n_texts") <= MAX_TEXTS)).select("value"), "secret-live")
    each = places.select("row", F.explode(F.filter("candidates", lambda c: c["random"])).alias("c")).select(
        "row", F.col("c.value").alias("value"), F.struct(
            F.col("c.value_start").alias("start"), F.lit(KINDS.index("live")).alias("kind"),
            F.col("c.value_end").alias("end")).alias("place"))
    if live.count() <= BROADCAST_KEYS:
        found = each.join(F.broadcast(live), "value")
    else:                                          # a text of very many copies is one value in very many rows
        live = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = each.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS))).join(live, ["value", "salt"])
    return found.groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("live"))


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def holders() -> tuple[Column, Column]:
    """(owner, repository) of rows of documents: the source, and the source's documents of one language."""
    return F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))


def scan_secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text",
                       owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    rows = stage(with_candidates(rows), "secret-rows")
    some = rows.filter(F.size("candidates") > 0)
    found = live_places(some, some)
    places = F.transform("candidates", lambda c: F.struct(c["start"], c["kind"], c["end"]))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = rows.select("row", "doc_id", places.alias("places")).join(found, "row", "left").withColumn(
        "all", F.sort_array(F.array_distinct(F.concat("places", F.coalesce("live", none)))))
    base = F.filter("all", lambda s: s["kind"] < len(BASE))

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{BASE[kind][0]}")

    counts = [count(k) for k in range(len(BASE))]
    return out.select("doc_id", *counts, F.sha2(_digest(base), 256).alias("base_sha256"),
                      _digest(F.col("all")).alias("spans"))


def redact(docs: DataFrame, owner: Column, repository: Column, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with live-looking values replaced by ``mask``; every row stays, with its other columns.

    A text's places depend on the text alone, so they are found once a distinct text and brought to the rows by the
    text's SHA-256. Places of a checked number are broadcast and the texts stay in the scan; more are joined by shuffle,
    salted, as one text may be a third of all rows.
    """
    columns = docs.columns
    at = columns.index("text")
    scanned = with_candidates(docs.select("text", owner.cast("string").alias("owner"),
                                          repository.cast("string").alias("repository")))
    dirty = stage(scanned.filter(F.exists("candidates", lambda c: c["random"])), "secret-dirty")
    texts = dirty.groupBy(F.col("digest").alias("row")).agg(F.first("candidates").alias("candidates"))
    live = stage(live_places(dirty, texts).withColumnRenamed("row", "digest"), "secret-places")
    n = live.agg(F.coalesce(F.sum(F.size("live")), F.lit(0))).first()[0]
    rows = docs.select(*numbered(columns), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    if n <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(live), "digest", "left")
    else:
        plain = [F.col(f"c{i}") for i, f in enumerate(docs.schema.fields) if i != at and isinstance(f.dataType, T.AtomicType)]
        live = live.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = rows.withColumn("salt", F.pmod(F.hash(F.lit(0), *plain), F.lit(SALTS))).join(live, ["digest", "salt"], "left")
    whole = F.col(f"c{at}")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("to"))
    cut = F.aggregate(F.col("live"), start, lambda a, s: F.struct(
        F.when(s["end"] <= a["to"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(whole, a["to"] + 1, F.greatest(s["start"] - a["to"], F.lit(0))),
            F.lit(mask))).alias("out"),
        F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: F.concat(a["out"], F.substring(whole, a["to"] + 1, F.length(whole))))
    return marked.withColumn(f"c{at}", F.when(F.size("live") > 0, cut).otherwise(whole)).select(*renamed(columns))


def _oracle() -> str:
    """Each pattern's matches and the pieces between them give the places; ``v`` is the value, ``lead`` what is before it.

    SQL's patterns have no look-around: a jwt is taken with the character before it, and a private key is stated for lines
    between white space, escapes and quotes that end in an END line. Keys broken otherwise or without END have a test.
    """
    word = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    tail = r"""["']?\x20*[:=]\x20*["']?"""
    value = "[A-Za-z0-9+/_.=-]+"
    gap = r"""(?:\\[nrt]|[\s"'`,>#*|\\]|//)*"""
    end = "-----END [A-Z ]{0,30}PRIVATE KEY-----"
    body = f"[A-Za-z0-9+/=]{{16,}}(?:{gap}[A-Za-z0-9+/=]{{16,}})*(?:{gap}[A-Za-z0-9+/=]{{1,15}})?"
    fields = rf"(?:{gap}[A-Z][A-Za-z0-9-]{{0,40}}:\x20[^\r\n\\]{{0,200}})*"
    plain = {KINDS.index(name): (p.pattern.removeprefix("(?a)"), None, 0, least)
             for name, p, _, least in [*BASE[1:], *MORE]}
    pem, jwt = KINDS.index("pem"), KINDS.index("jwt")
    key = f"{plain[pem][0]}(?:{fields}{gap}({body}){gap}{end})?"
    token = "eyJ" + r"\.".join(["[A-Za-z0-9_-]{8,}"] * 3)
    patterns = {0: (f"{word}{tail}{value}", f"{word}{tail}({value})", 2, 6), **plain, pem: (key, key, 1, 0),
                jwt: (f"(?:^|[^A-Za-z0-9_-]){token}", f"(?:^|[^A-Za-z0-9_-])({token})", 1, 0)}
    parts = []
    for kind, (whole, grouped, group, least) in patterns.items():
        w = whole.replace("'", "''")
        v = "m" if grouped is None else f"regexp_extract_all(t, '{grouped.replace(chr(39), chr(39) * 2)}', {group})"
        parts.append(f"""SELECT row, source, repository, {kind} AS kind, t, regexp_split_to_array(t, '{w}') AS pieces, m, {v} AS v,
                         {least} AS least FROM (SELECT *, regexp_extract_all(t, '{w}') AS m FROM d) WHERE len(m) > 0""")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, source,
                  coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
a AS ({" UNION ALL ".join(parts)}),
p AS (SELECT row, t, source, repository, kind, m[i] AS m, coalesce(v[i], '') AS raw, least,
             (list_sum(list_transform(pieces[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a)),
q AS (SELECT *, CASE WHEN kind = {pem} AND raw = '' THEN m ELSE raw END AS body FROM p WHERE length(raw) >= least),
c AS (SELECT row, t, source, repository, kind, CASE WHEN kind = {jwt} THEN s + length(m) - length(body) ELSE s END AS s,
             s + length(m) AS z, CASE WHEN kind = {pem} THEN s + strpos(m, body) - 1 ELSE s + length(m) - length(body) END AS vs,
             length(body) AS n, CASE WHEN kind = {pem} AND raw <> '' THEN regexp_replace(body, '\\[nrt]|[^A-Za-z0-9+/=]', '', 'g')
                                ELSE body END AS v FROM q),
h AS (SELECT v, t, source, repository FROM (SELECT DISTINCT v, t, source, repository FROM c)
      QUALIFY row_number() OVER (PARTITION BY v, t ORDER BY source NULLS FIRST, repository) = 1),
o AS (SELECT v, count(*) AS texts, count(DISTINCT coalesce(source, chr(1))) AS owners,
             count(DISTINCT coalesce(source, chr(1)) || repository) AS repos FROM h GROUP BY v),
u AS (SELECT v, sum(n) AS len, -sum(n / len * log2(n / len)) AS entropy FROM (
          SELECT v, length(v)::DOUBLE AS len, x, count(*) AS n FROM (SELECT v, unnest(string_split(v, '')) AS x FROM o) GROUP BY v, x)
      GROUP BY v),
live AS (SELECT DISTINCT row, vs AS s, {KINDS.index("live")} AS kind, vs + n AS z FROM c JOIN o USING (v) JOIN u USING (v)
         WHERE owners = 1 AND repos <= {MAX_REPOSITORIES} AND texts <= {MAX_TEXTS} AND length(v) >= 8
           AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND entropy >= {MIN_ENTROPY}),
sp AS (SELECT DISTINCT row, s, kind, z FROM c UNION SELECT row, s, kind, z FROM live),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
             count(*) FILTER (WHERE kind = 2) AS n_hex,
             string_agg({names}[kind + 1] || ':' || s || ':' || z, ',' ORDER BY s, kind, z) FILTER (WHERE kind < {len(BASE)}) AS base,
             string_agg({names}[kind + 1] || ':' || s || ':' || z, ',' ORDER BY s, kind, z) AS spans FROM sp GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


ORACLE_SQL = _oracle()
