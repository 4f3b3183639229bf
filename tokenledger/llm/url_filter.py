"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

A rule is a host, a path prefix and a verdict; it fits its host and all its
subdomains where the URL's path starts with the rule's path. Each URL is expanded
into the expressions a rule could have: for every shape that occurs among the
rules (labels of the host, characters of the path) the last labels of the URL's
host followed by the first characters of its path. A URL so has at most as many
expressions as there are shapes, however long it is. Expressions and rules meet in
an equi-join on the first ``PREFIX_HEX`` hex digits of their SHA-256; the full
digest confirms a match, and the rule of highest precedence decides: the longest
expression, then the longer host, then block before allow. URLs that no rule fits
get the filter's default verdict.

Rows carry an id staged with them, so only (row, digest) pairs travel to the join;
no URL, path or page does. Rules up to ``BROADCAST_RULES`` are broadcast; more are
joined by shuffle, the expressions salted over ``SALTS`` copies of each rule, so
that an expression which a third of all URLs share is dealt over many tasks.

Defined cases: a null URL or one without ``://`` has an empty host and path, and no
rule fits it; repeated rows and null ids give a row each; an empty table gives no
rows; other columns of the pages are not read, whatever their names; a rule whose
host or path is null is no rule, of equal rules the blocking one counts; no rules
at all leave every URL to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.staging import stage

PREFIX_HEX = 8
#: rules up to this many rows (a digest, a rule text of at most RULE_CHARS, a verdict) are broadcast
BROADCAST_RULES = 200_000
RULE_CHARS = 512
SALTS = 32

#: FIXED VALUES: host, path, verdict of the given rules
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """host, path, verdict of a list of rules."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def compiled(rules: DataFrame) -> DataFrame:
    """prefix, digest, labels, chars (of the path), length, rule, verdict: each rule once, the blocking one of equals."""
    named = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").filter(
        F.col("host").isNotNull() & F.col("path").isNotNull())
    once = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))       # "allow" < "block"
    text = F.concat("host", "path")
    digest = F.sha2(text, 256)
    return once.select(F.substring(digest, 1, PREFIX_HEX).alias("prefix"), digest.alias("digest"),
                       _labels(F.col("host")).alias("labels"), F.length("path").alias("chars"),
                       F.length("host").alias("host_chars"), F.length(text).alias("length"), text.alias("rule"), "verdict")


def expressions(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """row, prefix, digest of every expression of ``urls`` (row, host, path) that has one of the shapes."""
    each = [F.when((F.length("path") >= chars) & (_labels(F.col("host")) >= labels),
                   F.sha2(F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)), 256))
            for labels, chars in shapes]
    found = urls.select("row", F.explode(F.array_compact(F.array(*each))).alias("digest"))
    return found.select("row", F.substring("digest", 1, PREFIX_HEX).alias("prefix"), "digest")


def _met(found: DataFrame, table: DataFrame, broadcast_rules: int) -> DataFrame:
    """Expressions with the rule columns of every rule of the same short prefix."""
    table = table.withColumnRenamed("digest", "rule_digest")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    if size["n"] <= broadcast_rules and (size["longest"] or 0) <= RULE_CHARS:
        return found.join(F.broadcast(table), "prefix")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(
        table.select("*", salts), ["prefix", "salt"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
                broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule (or null), verdict of every row of ``pages`` (page_id, url)."""
    table = stage(compiled(rules), "url-rules")
    # the shapes: at most (labels of a host) x (lengths of a path) of the rules, whatever their number
    shapes = sorted((r["labels"], r["chars"]) for r in table.select("labels", "chars").distinct().collect())
    urls = stage(pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id"), host(F.col("url")).alias("host"),
                              path(F.col("url")).alias("path")), "url-rows")
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = _met(expressions(urls, shapes), table, broadcast_rules).filter(F.col("digest") == F.col("rule_digest"))
    best = (hits.groupBy("row").agg(F.max(F.struct("length", "host_chars", "verdict", "rule")).alias("best"))
            .select("row", "best.rule", "best.verdict"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", "rule",
                                                 F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT row_number() OVER () AS row, page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
b AS (SELECT row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
             arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
      GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (row)
"""
