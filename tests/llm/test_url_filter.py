import random

from pairwright.llm.url_filter import Rule, best_rule, build_trie, judge_urls

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "", "/x"), Rule("allow", "a.b", ""), Rule("block", "a.b", "")]


def brute(host, path):
    fits = [r for r in RULES if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def test_trie_is_brute_force():
    g, trie = random.Random(1), build_trie(RULES)
    for _ in range(3000):
        host = ".".join(g.choices(["example", "net", "com", "org", "a", "b", ""], k=g.randint(0, 4)))
        path = "".join(g.choices(["/", "en", "/en/", "/de/", "fr", "/x", "y", "/fr/"], k=g.randint(0, 4)))
        assert best_rule(trie, host, path) == brute(host, path), (host, path)


def test_rows(llm_spark):
    rows = [(1, "http://Www.EXAMPLE.net/en/1?x"), (2, None), (3, ""), (4, "no scheme"), (5, "https://x.net"), (6, "https://x.net/a#b"), (6, "https://x.net/a#b"), (7, "a://b://c/d")]
    pages = llm_spark.createDataFrame(rows, "page_id long, url string").withColumnsRenamed({}).selectExpr("*", "'clash' AS rule", "'clash' AS host")
    for most in (10, 0):  # broadcast trie, and join
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES, most_broadcast=most).fillna("-").collect())
        assert got == [(1, "www.example.net", "/en/1", "example.net/en/", "allow"), (2, "", "", "-", "allow"), (3, "", "", "-", "allow"), (4, "", "", "-", "allow"), (5, "x.net", "", "-", "allow"), (6, "x.net", "/a", "net/", "block"), (6, "x.net", "/a", "net/", "block"), (7, "b:", "//c/d", "-", "allow")]
    assert judge_urls(pages.limit(0), RULES).count() == 0
