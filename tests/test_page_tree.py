import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadweave.operators.network import key_value_rows, manager_blocks, network_records, page_structure
from leadweave.operators.page_tree import DEPTH, FORMATTING, tree_of

PIECE = re.compile(r"</?[a-z][a-z0-9]*[^>]*>|[^<]+|<")


def tokens(html):
    return PIECE.findall(html)


def code(token):
    name = re.match(r"</?([a-z][a-z0-9]*)", token)
    if not name:
        return "#" if token.strip() else ""
    return "/" + name[1] if token[1] == "/" else f"{name[1]} {token}" if name[1] in FORMATTING else "input hidden" if "hidden" in token else name[1]


def shape(html):
    """The tree as text: name(children), texts as written."""
    pieces = tokens(html)
    tree = tree_of("\n".join(map(code, pieces)))
    texts = [re.sub(r"^<[^>]+>", "", pieces[t]) for t in tree["texts"]]

    def inside(first, last, start, end):
        out, at = [], first
        while at < last:
            out += texts[start:tree["start"][at]]
            out.append(f"{tree['tag'][at]}({inside(at + 1, tree['last'][at], tree['start'][at], tree['end'][at])})")
            start, at = tree["end"][at], tree["last"][at]
        return " ".join(x for x in [*out, *texts[start:end]] if x.strip())

    return inside(0, len(tree["tag"]), 0, len(texts))


@pytest.mark.parametrize("html, want", [
    # rows and bodies that are implied
    ("<table><td>a<td>b</table>", "table(tbody(tr(td(a) td(b))))"),
    ("<table><tr><th>a<td>b<tr><td>c</table>d", "table(tbody(tr(th(a) td(b)) tr(td(c)))) d"),
    ("<table><thead><td>a<tbody><td>b</table>", "table(thead(tr(td(a))) tbody(tr(td(b))))"),
    ("<table><caption>t<td>a</table>", "table(caption(t) tbody(tr(td(a))))"),
    ("<table><colgroup><col><col><td>a</table>", "table(colgroup() col() col() tbody(tr(td(a))))"),
    # closes that are implied, and closes of nothing
    ("<table><tr><td><table><td>in</table>o<td>2</table>", "table(tbody(tr(td(table(tbody(tr(td(in)))) o) td(2))))"),
    ("<table><tr><td>a</div>b</table>", "table(tbody(tr(td(a b))))"),
    ("<div>a<table><tr><td>b</div>c</table>d</div>e", "div(a table(tbody(tr(td(b c)))) d) e"),
    ("x<td>y</td><tr>z</tr>", "x y z"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul(li(a ul(li(b))) li(c))"),
    ("<dl><dt>k<dd>v<dt>k2</dt><dd>v2</dl>", "dl(dt(k) dd(v) dt(k2) dd(v2))"),
    ("<p>a<div>b</div>c", "p(a) div(b) c"),
    ("<h1>a<h2>b</h1>c", "h1(a) h2(b) c"),
    ("<div><span>a</div>b", "div(span(a)) b"),
    ("<table><td>a<table><td>b", "table(tbody(tr(td(a table(tbody(tr(td(b))))))))"),
    ("<table><tr><table><td>a</table>", "table(tbody(tr())) table(tbody(tr(td(a))))"),
    ("<select><option>a<option>b</select>c", "select(option(a) option(b)) c"),
    # content moved out of tables
    ("<div><table>x<tr>y<td>a</td>z<div>w</div></tr></table>e</div>", "div(x y z div(w) table(tbody(tr(td(a)))) e)"),
    ("<table><tr> <td>a</td> </tr> </table>", "table(tbody(tr(td(a))))"),
    ("<table><div>q<tr><td>1</div>2</table>", "div(q) table(tbody(tr(td(1 2))))"),
    ("<table><form><td>a</form><input type=hidden><td>b</table>", "table(form() tbody(tr(td(a input()) td(b))))"),
    ("<table><script>s</script><td>a</table>", "table(script(s) tbody(tr(td(a))))"),
    # formatting: the standard's own examples
    ("<p>1<b>2<i>3</b>4</i>5</p>", "p(1 b(2 i(3)) i(4) 5)"),
    ("<b>1<p>2</b>3</p>", "b(1) p(b(2) 3)"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "b() b(bbb) table(tbody(tr(td(aaa)))) b(ccc)"),
    ("<p><b>x<p>y", "p(b(x)) p(b(y))"),
    ("<ul><li><b>A<li>B</ul>", "ul(li(b(A)) li(b(B)))"),
    ("<table><td><b>a<td>b</table>c", "table(tbody(tr(td(b(a)) td(b)))) c"),
    ("<a>1<div>2<a>3</a></div>", "a(1) div(a(2) a(3))"),
    ("<b><b><b><b>x</b></b></b></b>y", "b(b(b(b(x)))) y"),
    ("<b>1<i>2<div>3</b>4</i>5</div>", "b(1 i(2)) i() div(i(b(3) 4) 5)"),
])
def test_shapes(html, want):
    assert shape(html) == want


SOUP = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<tbody>", "<caption>", "</caption>", "<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<a href=1>", "</a>", "<li>", "<ul>", "</ul>",
        "<dl>", "<dt>", "<dd>", "</dl>", "<h3>", "</h3>", "<span>", "</span>", "<br>", "<script>x", "</script>", "<button>", "<form>", "<input type=hidden>", "<option>", "<object>", "</object>", "text", " "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SOUP), min_size=1, max_size=60))
def test_any_tags_give_a_tree(pieces):
    tree = tree_of("\n".join(map(code, pieces)))
    assert sorted(tree["texts"]) == [i for i, p in enumerate(pieces) if p in ("text", " ", "<script>x")]  # each text once
    n, open_ = len(tree["tag"]), []
    for i in range(n):
        while open_ and tree["last"][open_[-1]] <= i:
            open_.pop()
        if open_:
            assert tree["last"][i] <= tree["last"][open_[-1]] and tree["start"][open_[-1]] <= tree["start"][i] <= tree["end"][i] <= tree["end"][open_[-1]]
        parent = tree["tag"][open_[-1]] if open_ else ""
        assert tree["tag"][i] not in ("td", "th") or parent == "tr"
        assert tree["tag"][i] != "tr" or parent in ("tbody", "thead", "tfoot")
        if tree["next"][i] >= 0:
            assert tree["last"][i] == tree["next"][i]
        open_.append(i)


@pytest.mark.parametrize("html", ["<div>" * 100_000, "<b>" * 100_000 + "<div>x" * 500, "<table>" + "x<b>" * 20_000, "<li><div>" * 40_000, "<a>x" * 40_000, "</div>" * 100_000, "<table><tr><td>" * 30_000, "<b><p>" * 10_000 + "</b>" * 10_000])
def test_odd_pages_cost_their_length(html):
    codes = "\n".join(map(code, tokens(html)))
    started = time.process_time()
    tree = tree_of(codes)
    assert time.process_time() - started < 20 and len(tree["texts"]) == html.count("x")


def test_deep_elements_become_siblings():
    tree = tree_of("\n".join(["div"] * (DEPTH + 50) + ["#"] + ["/div"] * (DEPTH + 50) + ["p", "#"]))
    assert tree["tag"].count("div") == DEPTH + 50 and tree["start"][-1] == 1 and tree["last"][0] == DEPTH + 50  # the paragraph stands after them all


def test_irregular_pages(spark):
    pages = [("<table><td>Minimum payout<td>$9</table>", [("Minimum payout", "$9")], [], []),
             ("<table>Account manager: <tr><td>Referral</td>lost<td>2%</table>", [("Referral", "2%")], [], []),
             ("<div><table>Account manager: <tr><td>Referral</td>lost<td>2%</table></div>", [("Referral", "2%")], ["Account manager: lostReferral2%"], ["Account manager"]),
             ("<ul><li>Account manager <b>Ann &amp; Co<li>account manager Bob</ul>", [], ["Account manager Ann & Co", "account manager Bob"], ["Ann & Co", "account manager Bob"]),
             ("<td>Account manager<tr><td>x", [], [], []), (None, [], [], []), ("", [], [], [])]
    df = spark.createDataFrame([(i, "A", p[0]) for i, p in enumerate(pages)], "page_id long, layout string, html string")
    m, t, lay = F.col("marks"), F.col("texts"), F.col("layout")
    got = {r.page_id: r for r in page_structure(df).select("page_id", key_value_rows(m, t).alias("rows"), manager_blocks(m, t, lay).alias("blocks")).collect()}
    names = {r.page_id: [x.name for x in r.network.managers] for r in network_records(df).collect()}
    for i, (_, rows, blocks, managers) in enumerate(pages):
        assert [(r.label, r.value) for r in got[i].rows or []] == rows and [b.text for b in got[i].blocks or []] == blocks and names[i] == managers, i
