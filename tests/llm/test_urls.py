"""The URL trie against a plain look at all rules."""

import random
import re

import pytest

from threadloom.llm import urls


def brute(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h.split(".")) if h else 0, len(p), a, h + p) for a, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(fit)
    return host, path, best[3], best[2]


def some_urls(n=600):
    rng = random.Random(5)
    part = lambda: rng.choice(["com", "example", "WWW", "net", "a", "b", "", "é", "x:80"])
    out = []
    for _ in range(n):
        host = ".".join(part() for _ in range(rng.randint(1, 5)))
        path = "".join("/" + rng.choice(["en", "es", "e", "", "fr", "en/x", "%65n"]) for _ in range(rng.randint(0, 4)))
        out.append(rng.choice(["http://", "https://", "", "x://y://", "\n://"]) + host + path + rng.choice(["", "?a=://b/", "#/en/", "/?x#y"]))
    return [*out, None, "", "://", "http://", "http://com", "http://com/", "http://" + "a." * 20_000 + "com/" + "z/" * 200_000, "http://example.com/" + "e" * 300_000]


def some_rules(rng, n):
    hosts = ["com", "example.com", "net", "www.example.com", "a.b.com", "b", "", "x:80", "é.com", ".com"]
    paths = ["/", "/en/", "/e", "/en", "", "/es/", "/en/x", "//", "/fr/e"]
    return [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(n)]


@pytest.mark.parametrize("block", [500, 7])
def test_against_all_rules(spark, block):
    """``block``: all rules in one trie, and in several whose matches compete."""
    rng, found = random.Random(7), some_urls()
    for rules in (list(urls.RULES), some_rules(rng, 12), some_rules(rng, 60)):
        pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(found)], "page_id long, url string, rule string").repartition(3)
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, trie_rules=block).collect()}
        assert got == {k: brute(u, rules) for k, u in enumerate(found)}


def test_rules_in_a_table_defaults_and_errors(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/")], "page_id long, link string")
    rules = spark.createDataFrame([("block", "com", "/")] * 2 + [("allow", "com", "/")], "action string, host string, path string")
    rows = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules, url="link", default="block").collect()}
    assert rows == {1: ("com/", "block"), 2: (None, "block")}
    assert {r.verdict for r in urls.judge(pages, [], url="link").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), urls.RULES, url="link").count() == 0
    for bad in [("deny", "com", "/"), ("allow", None, "/")]:
        with pytest.raises(ValueError):
            urls.judge(pages, [bad], url="link")
