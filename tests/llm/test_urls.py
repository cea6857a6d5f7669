"""URL rules against a plain loop over rules."""

import random

from pulseloom.llm import urls


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        path = tail[:stop]
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1] or "")]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1] or ""), r[2]), default=None)
    return host, path, best and best[0] + (best[1] or ""), best[2] if best else "allow"


def check(spark, pages, rules, **more):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(pages)], "page_id long, url string, host string").repartition(4)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, table, **more).collect()}
    assert got == {i: plain(u, [r for r in rules if r[2]]) for i, u in enumerate(pages)}


def test_random_nested_rules(spark):
    rnd = random.Random(3)
    labels = ["a", "b", "c-d", "e", "é"]

    def host():
        return ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 5)))

    paths = ["", "/", "/x", "/x/", "/x/y", "/z"]
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((host(), rnd.choice(paths)) for _ in range(70))}.values())
    pages = [f"http://{host()}{rnd.choice(paths)}{rnd.choice(['', '?q=/x/', '#/x/'])}" for _ in range(600)] + ["http://a/x"] * 300
    check(spark, pages, rules)


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("com", "/", None)]
    check(spark, [None, "", "net/", "http://", "http://NET/", "http://xnet/", "ftp://a.Example.NET/en/?x", "http://example.net", "http://example.net?/en/",
                  "a://b://net/", "http://É.org", "http://org:80/", "http://.net/", "http://a.com/", "x" * 50_000 + "://net/"], rules)


def test_without_rules_or_pages(spark):
    check(spark, ["http://a.b/c"], [])
    check(spark, [], [("net", "/", "block")])


def test_equal_rules_block_wins(spark):
    check(spark, ["http://a.net/x"], [("net", "/", "allow"), ("net", "/", "block")])
