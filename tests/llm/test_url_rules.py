from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glucoframe.llm import url_rules as rules

PAGES = "page_id long, url string"


def brute(url: str | None) -> tuple:
    """The contract's words, rule by rule, without index or expressions for the prefix rules."""
    if url is None or "://" not in url:
        return "", "", None, "allow", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path, rest = re.split("[?#]", rest[len(host) :], maxsplit=1)[0], rest[len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in rules.PREFIX_RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.text), r.text, r.verdict))
    if fits:
        return host, path, *max(fits)[1:], None
    low = re.sub("[A-Z]", lambda m: m[0].lower(), host + rest)
    hits = [r for r in rules.PATTERN_RULES if (host or rest) and re.search(r.regex().replace(r"\z", r"\Z"), low)]
    allowing, blocking = (max((r.text for r in hits if r.verdict == v), default=None) for v in ("allow", "block"))
    return host, path, None, "block" if blocking and not allowing else "allow", allowing or blocking


URLS = [
    "http://a.example.net/en/x", "http://example.net/en/", "http://example.net/EN/", "http://EXAMPLE.net/en/?q", "http://example.net/en", "http://x.net", "http://x.net/", "http://x.net?/",
    "http://notexample.com/de/", "http://example.com/de/#a", "http://a.org/fr/", "http://org/fr/x", "http://a.com/x.net/en/", "http://x.net:80/", "ftp://SPAM-farm.example.org/p",
    "http://www.spam-farm.info/", "http://nospam-farm.org/", "http://a.org/?u=http://b.net/", "http://a.org/ADS/1", "http://a.org/x?click?id=3", "http://a.org/click?id=3", "http://a.org/banner/q.gif",
    "http://a.org/banner/q.png", "http://example.org/x/help/ads/", "http://example.org/ads/help/", "no scheme", "", None, "://", "://net/", "http:///net/", "http://é.net/en/", "http://x.org/\nads/", "a://b://c.net/",
    "http://doubleclick.net/", "http://x.doubleclick.org/", "http://x.org/" + "long/" * 50_000 + "ads/",
]


def test_urls_against_brute_force(spark, docs_folder):
    urls = URLS + [r.url for r in spark.read.parquet(f"{docs_folder}/pages.parquet").collect()]
    rows = list(enumerate(urls)) + [(None, "http://x.net/"), (3, "http://x.net/")]
    frame = spark.createDataFrame(rows, PAGES).select("*", *[F.lit(1).alias(n) for n in ("host", "path", "of", "token", "rule", "prefix", "rest", "address")])
    found = sorted(((r.page_id is None, r.page_id or 0, *[x or "" for x in (r.host, r.path, r.rule, r.verdict, r.pattern)]) for r in rules.judge(frame).collect()))
    assert found == sorted((k is None, k or 0, *[x or "" for x in brute(u)]) for k, u in rows)


def test_no_rows_and_no_rules(spark):
    assert rules.judge(spark.createDataFrame([], PAGES)).count() == 0
    frame = spark.createDataFrame([(1, "http://x.net/")], PAGES)
    assert [(r.rule, r.verdict) for r in rules.judge(frame, prefix_rules=(), pattern_rules=()).collect()] == [(None, "allow")]


def test_index_takes_the_rarest_token(spark):
    table = rules.rule_table(spark, [rules.block("/ads/banner/"), rules.block("*casino*")], False)
    words = spark.createDataFrame([("ads",), ("banner",), ("ads",)], "token string")
    assert {r.rule: r.token for r in rules.indexed(table, words).collect()} == {"/ads/banner/": "banner", "*casino*": rules.ANY_TOKEN}


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "http://x.net/")], PAGES)
    plan = rules.judge(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/.-?", max_size=12), st.text(alphabet="ab/^*.|-", max_size=6))
def test_a_rules_tokens_are_tokens_of_every_match(address, pattern):
    rule = rules.block(pattern)
    if re.search(rule.regex().replace(r"\z", r"\Z"), address):
        assert set(rule.tokens()) <= set(re.findall("[a-z0-9]+", address))
