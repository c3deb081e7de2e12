"""URL filters: trie, join and brute force agree; edge cases."""

import random
import re

import pytest

from marketspark.llm import url_filter as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.org", ""), ("allow", "org", "/f"), ("block", "b.a.org", "/x/y")]
URLS = [None, "", "no scheme", "http://", "http://net", "http://x.net/", "HTTP://A.Example.NET/en/1?q#f", "https://example.net/en", "http://example.com/de/x", "http://nexample.com/de/x", "ftp://a.org?x=/fr/", "x://org/fr/", "x://org/fa", "http://b.a.org/x/yz", "http://b.a.org/x/", "http://ÄB.org/fr/", "a://b://c.net/", "http://example.net:80/en/", "http://.net/x", "http://x\n.net/\n"]


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most_rules", [100, 0])
def test_same_as_trying_every_rule(spark, most_rules):
    rng = random.Random(1)
    urls = URLS + ["http://" + ".".join(rng.choice(["a", "b", "example", "x"]) for _ in range(rng.randrange(3))) + rng.choice([".net", ".org", ".com"]) + rng.choice(["", "/", "/en/", "/fr", "/fr/q", "/f", "/x/y"]) for _ in range(300)]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    got = U.filter_urls(df, RULES, most_rules=most_rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted((k, *brute(u)) for k, u in enumerate(urls))


def test_empty_table_and_bad_rules(spark):
    df = spark.createDataFrame([], "url string")
    assert U.filter_urls(df, RULES).count() == 0
    with pytest.raises(ValueError):
        U.filter_urls(df, [("maybe", "x", "/")])


def test_odd_names_long_urls_repeated_rows_and_empty_table(spark):
    long = "http://a.net/" + "x/" * 50_000
    rows = [(long, 1, 2, 3)] * 3 + [(None, 1, 2, 3), ("", 1, 2, 3)]
    df = spark.createDataFrame(rows, "url string, _action int, _v int, _b int")
    for most in (10, 0):
        got = U.filter_urls(df, [("block", "net", "/")], most_rules=most).collect()
        assert sorted(r["verdict"] for r in got) == ["allow"] * 2 + ["block"] * 3 and {(r["_action"], r["_v"], r["_b"]) for r in got} == {(1, 2, 3)}
        assert U.filter_urls(df.limit(0), [("block", "net", "/")], most_rules=most).count() == 0
