import math

from helpers import rows

from millrace.llm.url_filter import RULES, host_reputation, op6_url_filter, url_filter


def brute_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/7x?y", "http://example.com/en/7", "http://example.com/en", "x://b.com?/en/", "http://de.example.net/de/8/z#q", "http://q.net/de/1", "http://net/de/", "http://xnet/de/", "http://s.org/es/", "http://s.org/ES/", "http://u:p@h.com:80/en/", "a://b://c/d", "http://é.com/en/\nx", "http://com/en/" + "y" * 5000]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(URLS)], "page_id long, url string, a string")
    for r in url_filter(df).collect():
        url = r.url or ""
        _, found, rest = url.partition("://")
        host = ""
        path = ""
        if found:
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict or rule is None


def test_reputation_shrinks(spark):
    bad = [("spam.x.com", 1)] * 40 + [("good.x.com", 0)] * 40 + [("one.y.org", 1)] + [(f"h{i}.y.org", 0) for i in range(30)] + [("all.bad.net", 1)] * 60
    outcomes = spark.createDataFrame(bad, "host string, bad int")
    hosts, domains, suffixes, top = host_reputation(outcomes)
    mean = {r.host: r.a / (r.a + r.b) for r in hosts.collect()}
    assert mean["spam.x.com"] > 0.9 and mean["good.x.com"] < 0.1 and mean["h3.y.org"] < mean["one.y.org"] < 0.7
    assert math.isclose(top.first().a + top.first().b, len(bad) + 2)
    urls = ["http://spam.x.com/a", "http://good.x.com/a", "http://one.y.org/a", "http://new.bad.net/", "http://other.example/"]
    got = {r.url: r.verdict for r in url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), rules=(), outcomes=outcomes).collect()}
    assert got == dict(zip(urls, ["block", "allow", "allow", "block", "allow"], strict=True))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "http://a.de/x", "h", "v")] * 3, "page_id long, url string, host string, suffix string")
    got = url_filter(df)
    assert got.columns == ["page_id", "url", "suffix", "host", "path", "rule", "verdict"]
    assert rows(got) == [(1, "http://a.de/x", "v", "a.de", "/x", None, "allow")] * 3
    assert rows(url_filter(df.limit(0))) == []


def test_query(spark, sf_dir):
    got = op6_url_filter(spark, sf_dir)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and got.count() == 50
    assert {r.verdict for r in got.collect()} <= {"allow", "block"}
