"""Url rules against a plain look at every rule."""

import random

import pytest

from tablelens.llm import url_rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = path = ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
        host += c
    for c in rest[len(host):]:
        if c in "?#":
            break
        path += c
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_rules.judge(pages, url_rules.rules_of(spark, rules))
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert rows == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_dealt_rules(spark):
    urls = [None, "", "example.com/en/", "http://", "HTTP://Www.EXAMPLE.com/en/x?y#z", "https://example.com/en/", "https://example.com/en", "http://com",
            "http://com/", "http://xcom/", "http://a.b.www.example.com/en/", "http://example.net/es/", "http://net/fr/x", "x://y://net/es/",
            "http://.com/", "http://example.com./en/", "http://com#/es/", "http://É.NET/es/", "http://user@net:80/fr/", "http://net/es/\nline"]
    check(spark, urls + urls + ["http://m.example.com/en/" + "y" * 200_000], RULES)


@pytest.mark.parametrize("seed", range(2))
def test_nested_rules_over_many_buckets(spark, seed):
    rng = random.Random(seed)

    def host():
        return ".".join(rng.choice(["a", "b", "com", "", "é"]) for _ in range(rng.randint(1, 4)))

    def path():
        return "".join("/" + rng.choice(["x", "xy", "", "é", "\U0010ffff"]) for _ in range(rng.randint(0, 4)))
    rules = list({(host() if rng.random() < 0.95 else "", path()): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    urls = ["http://" + host() + path() + rng.choice(["", "?q", "#f"]) for _ in range(1500)] + ["http://a.com/x"] * 500
    check(spark, urls, [(h, p, v) for (h, p), v in rules])


def test_rules_without_sense_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([(None, None, "block"), ("a.com", "x", "allow"), ("a.com", "/x", None), ("A.COM", "/", "allow"), ("a.com", "/", "block")],
                                  "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).first()[2:] == ("a.com", "/x", "a.com/", "block")
    assert url_rules.judge(pages, rules.limit(0), default="block").first()[2:] == ("a.com", "/x", None, "block")
    assert url_rules.judge(pages.limit(0), rules).count() == 0
