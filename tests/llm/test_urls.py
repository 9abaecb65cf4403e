"""The URL filter: the inline index, the joined one, and a plain loop agree."""

import re

from corpusloom.llm import urls
from corpusloom.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://example.com/en/1", "http://EXAMPLE.com/en/71?q", "http://a.example.com/en/7", "http://badexample.com/en/7", "https://x.net/de/8", "https://www.example.net/de/8#x", "http://org/es/", "http://org/ES/", "http://my-casino.info/", "http://mycasino.info/", "://", "http://example.com/en/1"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    spam = set(re.split("[^a-z0-9]+", host)) & set(urls.SPAM_HOST_WORDS)
    return host, path, None, "block" if spam else "allow"


def test_filter(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    pages = pages.selectExpr("*", "'x' AS rule", "1 AS token")
    rules = [urls.prefix_rule(*r) for r in URL_RULES] + urls.spam_rules()
    for inline in (256, 0):
        got = urls.filter_urls(pages, rules, inline=inline).orderBy("page_id").collect()
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [plain(u) for u in URLS]
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_own_columns_stay(spark):
    df = spark.createDataFrame([("http://a.com/en/1", 1, 2, 3, "old")], "url string, _best int, _key int, row int, host string")
    for inline in (0, 100):
        got = urls.filter_urls(df, [urls.prefix_rule("block", "com", "/en/")], inline=inline).first().asDict()
        assert got == {"url": "http://a.com/en/1", "_best": 1, "_key": 2, "row": 3, "host": "a.com", "path": "/en/1", "rule": "com/en/", "verdict": "block"}


# As the contract lists them, written out apart from the code's own list.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_those_of_the_contract(spark):
    assert ", ".join(f"{action} {host}{path}" for action, host, path in URL_RULES) == CONTRACT
    urls_ = ["http://x.net/de/8", "http://a.example.net/de/7", "http://a.example.net/de/81", "http://casino.net/de/1", "http://casino.net/fr/1"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id int, url string")
    got = urls.filter_urls(pages, [urls.prefix_rule(*r) for r in URL_RULES] + urls.spam_rules()).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "block")]
