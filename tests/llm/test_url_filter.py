"""URL verdicts against plain Python; the salted join against the broadcast one."""

import re

import pytest

from tests.llm.cases import rows
from tokenledger.llm import url_filter as U

URLS = [
    (1, "http://example.org/es/1?x"), (2, "HTTPS://WWW.Example.ORG/ES/1"), (3, "https://a.b.example.org/en/12#t"),
    (4, "http://notexample.org/es/"), (5, "http://example.com/fr/x"), (6, "http://example.com/de/x/"), (7, "x://com/de"),
    (8, None), (9, ""), (10, "no scheme"), (11, "http://"), (12, "http://example.org"), (13, "http://example.org?q=/es/"),
    (14, "a://b://example.org/es/"), (15, "http://com.example/fr/"), (16, "http://example.org:80/es/"),
    (17, "http://user@example.org/es/"), (18, "http://example.org./es/"), (19, "http://ÉXAMPLE.org/ñ/"), (None, "http://x.com/de/"),
    (1, "http://example.org/es/1?x"), (20, "http://" + "a." * 50_000 + "example.org/en/1" + "x" * 1_200_000),
    (21, "line\nhttp://example.org/es/\n?"), (22, "http://.org/"), (23, "http://😀.example.org/es/😀"),
]


def brute(url, rules, default="allow"):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


def table(spark, data=URLS):
    return spark.createDataFrame(data, "page_id long, url string")


MORE = [("org", "", "block"), ("example.org", "/es/1", "allow"), ("b.example.org", "/", "block"), ("a.b.example.org", "/en", "allow"),
        ("com", "/fr/", "block"), ("com", "/fr/", "allow"), ("É.org", "/", "block"), ("", "/", "block")] + U.RULES


@pytest.mark.parametrize("rules", [U.RULES, MORE])
@pytest.mark.parametrize("bound", [U.BROADCAST_RULES, 0])
def test_matches_plain_rules(spark, rules, bound):
    out = U.filter_urls(table(spark).repartition(3), U.rule_table(spark, rules), broadcast_rules=bound)
    assert rows(out) == sorted(((i, *brute(u, rules)) for i, u in URLS), key=repr)


def test_edges(spark):
    from pyspark.sql import functions as F
    rules = U.rule_table(spark)
    df = table(spark)
    for c in ("row", "host", "path", "rule", "verdict", "digest", "prefix", "best", "labels", "length", "salt"):
        df = df.withColumn(c, F.lit("x"))
    assert rows(U.filter_urls(df, rules)) == rows(U.filter_urls(table(spark), rules))
    assert U.filter_urls(table(spark, []), rules).collect() == []
    none = U.rule_table(spark, [(None, "/", "block"), ("com", None, "block")])
    assert {r["verdict"] for r in U.filter_urls(table(spark), none, default="block").collect()} == {"block"}


def test_a_url_has_as_many_expressions_as_rule_shapes(spark):
    deep = spark.createDataFrame([(0, "a." * 1000 + "example.org", "/en/1" * 1000)], "row long, host string, path string")
    shapes = {(r["labels"], r["chars"]) for r in U.compiled(U.rule_table(spark)).collect()}
    assert U.expressions(deep, sorted(shapes)).count() == len(shapes) == 4
