from leadweave.llm import url_filter
from tests.llm.cases import unchanged

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/x", "block"), ("a.b", None, "block"), ("a.b", "", "allow"), (None, "/", "block"), ("", "/", "block")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), (h + p).lower() if False else h + p, v) for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/x", "block"), ("a.b", "", "block"))
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_urls(spark):
    urls = ["http://x.example.NET/en/1", "http://example.net/de/", "http://example.net", "https://net/", "http://anet/", "http://www.example.com/de/xyz", "http://www.example.com/de/y", "http://u.example.com/de/x",
            None, "", "no scheme", "x://a.b?q", "x://A.B#f", "x://z.a.b/p/q/r", "http://b/", "://net/", "a://b://net/", "http:///en/", "http://example.net/en", "http://net/" + "p/" * 20000, "http://" + "a." * 5000 + "net/",
            "http://Ä.net/x", "http://example.net/en/1?a=/de/", "http://x.example.NET/en/1", "line\nbreak://net/\n/x"]
    pages = spark.createDataFrame([(i, u, "x", "h") for i, u in enumerate(urls)], "page_id long, url string, row string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: brute(u) for i, u in enumerate(urls)}
    unchanged(got, pages, "host", "path", "rule", "verdict")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
