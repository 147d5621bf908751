import pytest
from pyspark.sql import functions as F

from leadweave.functions import urls
from leadweave.plans.leads import DEFAULT_ROUTES, with_layout
from tests.conftest import values

CARDS = [
    ("/foo", "https://h.example/a/b?x", "https://h.example/foo"), ("foo?x=1#y", "https://h.example/a", "https://h.example/foo"),
    ("../foo", "https://h.example/a/b", "https://h.example/foo"), ("//H.example:8080/Foo/", "https://h.example/a", "https://H.example:8080/Foo/"),
    ("https://other/x", "https://h.example", None), ("#a", "https://h", None), ("mailto:x", "https://h", None), ("JAVASCRIPT:x", "https://h", None),
    ("/oiré", "https://h.example/a", "https://h.example/oir%C3%A9"), ("/a%20b!", "https://h", "https://h/a%20b!"), ("/login", "https://h", None),
    ("/page-2", "https://h", None), ("/a/b", "https://h", None), ("foo", "https://h", "https://h/foo"), ("/a%2Fb", "https://h", None), ("/x%zz", "https://h", None),
    ("a:b", "https://h", None), ("?q=1", "https://h/cat", "https://h/cat"), ("/affpaying", "https://h", None), ("  /x/  ", "https://h/y/z", "https://h/x/"), ("", "https://h/y", None),
]


def test_card_links(spark):
    df = spark.createDataFrame(CARDS, "h string, b string, want string").select("h", urls.card_link("h", "b").alias("got"), "want")
    assert [r for r in values(df, "h", "got", "want") if r[1] != r[2]] == []


def test_profile_links(spark):
    cases = [("/network/alpha?x=1", "https://h/network/alpha"), ("/NETWORK/a/b", "https://h/NETWORK/a/b"), ("/networks/", None), ("/network/", None), ("https://o/network/a", None)]
    df = spark.createDataFrame(cases, "h string, want string").select("h", urls.profile_link("h", F.lit("https://h/networks/")).alias("got"), "want")
    assert [r for r in values(df, "h", "got", "want") if r[1] != r[2]] == []


def test_page_url(spark):
    cases = [("https://h.example/c?z=1&a=b c&page=9#f", 2, "https://h.example/c?a=b+c&page=2&z=1"), ("https://h/c", 1, "https://h/c?page=1"), ("HTTPS://h/é?a=%7E*+x&a=1&b", 3, "https://h/%C3%A9?a=~%2A+x&a=1&b=&page=3")]
    df = spark.createDataFrame(cases, "u string, n int, want string").select(urls.page_url("u", "n").alias("got"), "want")
    assert [r for r in values(df, "got", "want") if r[0] != r[1]] == []


@pytest.mark.parametrize("as_table", [False, True])
def test_routing_and_rejects(spark, as_table):
    cases = [("https://affpaying.com/x", "A"), ("https://WWW.AffPaying.com./x", "A"), ("https://www.offervault.com/network/x", "B"), ("https://else.example", "default")]
    routes = spark.createDataFrame(list(DEFAULT_ROUTES.items()), "host string, layout string") if as_table else DEFAULT_ROUTES
    df = with_layout(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "page_id long, url string, want string"), routes)
    assert [r for r in values(df, "url", "layout", "want") if r[1] != r[2]] == []
    bad = spark.createDataFrame([("not-a-url",), ("/rel",), ("http://a b/c",), (None,), ("https://ok.example",), ("http://a_b.example/x y",)], "url string")
    assert values(bad.filter(urls.url_problem("url").isNotNull()), "url") == ["not-a-url", "/rel", "http://a b/c", None]


def test_hosts_as_a_url_parser_reads_them(spark):
    cases = [("https://[2001:db8::1]:8443/x", "2001:db8::1"), ("https://[::1]/x", "::1"), ("https://h.example:80/x", "h.example"), ("https://h.example:/x", "h.example"), ("https://h.example:a1/x", ""),
             ("//h.example/x", "h.example"), ("https://u:p@w@H.example?q", "h.example"), ("https:///x", ""), ("https://[::1/x", ""), ("plain", "")]
    df = spark.createDataFrame(cases, "u string, want string").select("u", urls.source_domain("u").alias("got"), "want", urls.url_problem("u").isNull().alias("usable"))
    assert [r for r in values(df, "u", "got", "want") if r[1] != r[2]] == []
    assert sorted(values(df.filter("usable"), "u")) == sorted(u for u, host in cases if host and not u.startswith("//"))
