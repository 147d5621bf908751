"""License scan, HTML extraction, WARC derivatives."""

import base64
import gzip
import hashlib
import itertools
import random
import time
import re

import duckdb
import pytest

from leadweave.llm import html_extract, license_scan, warc
from leadweave.llm.catalog import QUERIES
from leadweave.llm.html_blocks import blocks
from tests.llm.cases import odd_docs, prose, unchanged


def test_longest_increasing_and_alignment():
    rng = random.Random(4)
    for _ in range(200):
        values = [rng.randrange(12) for _ in range(rng.randrange(9))]
        run = [values[i] for i in license_scan.longest_increasing(values)]
        assert all(a < b for a, b in itertools.pairwise(run))
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if all(a < b for a, b in itertools.pairwise(c))), default=0)
        assert len(run) == best
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(10))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(pairs))


def test_licenses(spark):
    mit, gpl = license_scan.TEMPLATES["MIT-text"], license_scan.TEMPLATES["GPL-3.0"]
    cases = [(f"{prose(1)}\n{gpl}\n{prose(2)}", ["GPL-3.0"]), (f"{gpl} {prose(3)} {gpl}", ["GPL-3.0"]), (mit.upper().replace("\"", "'"), ["MIT-text"]), (mit.replace("free of charge", "at no cost"), ["MIT-text"]),
             ("license license the under " * 50, []), (prose(4), []), (f"{prose(5, 30000)} Released under the MIT License.", ["MIT"]), ("Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("w w w " + "Licensed under CC BY-NC 4.0. " * 5, ["CC-BY-NC-4.0"]),
             ("released " + prose(6, 40) + " under " + prose(7, 40) + " the license", []), (license_scan.TEMPLATES["Apache-2.0-header"], ["Apache-2.0", "Apache-2.0-header"])]
    got = license_scan.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [{f.license for f in r.licenses} for r in got] == [set(w) for _, w in cases] and got[10].licenses[0].license == "Apache-2.0-header"
    docs = odd_docs(spark)
    unchanged(license_scan.scan_licenses(docs), docs, "licenses")
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_blocks():
    page = "<body><p>a&amp;b &lt;<b>c</b>\n d<br>e<p>f<script>var t='</p>';</script><ul><li>g<li><a href=x>h</a></ul>tail<!-- no --><td>k</div>&am"
    assert [b.text for b in blocks(page)] == ["a&b <c d e", "f", "g", "h", "tail", "k&am"]
    assert blocks(None) == [] and blocks("<") and blocks("<div class='Main-Body x1'>t")[0].names == ("main", "body", "x")
    assert len(blocks("<p>x" * 20000)) == 20000 and len(blocks("<div>" * 3000 + "deep")[0].path) == 3000


def test_blocks_cost_the_length_of_the_page():
    for html, n in (("<div>" * 100_000 + "x", 1), ("<div>x" * 100_000, 100_000), ("<svg>" * 100_000 + "<p>x", 1), ("<div>" * 50_000 + "</p>" * 50_000, 0), ("<p>x" * 50_000, 50_000),
                    ("".join(f"<div class=c{i}>x" for i in range(20_000)), 20_000)):
        started = time.process_time()
        assert len(blocks(html)) == n and time.process_time() - started < 5, html[:20]
    started = time.process_time()
    assert len(html_extract.features(blocks("<div>x" * 50_000))) == 50_000 and time.process_time() - started < 10
    shared = blocks("<div class='Main x'><p>a<div id=y>b</div>c</div>")
    assert [(b.path, b.names) for b in shared] == [(("div", "p"), ("main", "x")), (("div", "div"), ("main", "x", "y")), (("div",), ("main", "x"))]


# layouts of other builders than those the field is trained on; main text is what stands in the place of {main}
FOREIGN = [
    '<body><div id="top"><ul class="mainmenu"><li>Start</li><li>Archive</li><li>Contact</li></ul></div><div id="story">{main}</div><div class="promo related"><p>Ten ways to cook rice</p></div><div id="footer"><p>© The Paper</p></div></body>',
    '<body><header><nav><a href=1>Start</a> <a href=2>Archive</a></nav></header><main>{main}</main><section id="comments"><p>Great read, thank you all.</p><p>I do not agree with this.</p></section><footer><p>All rights reserved.</p></footer></body>',
    '<body><div role="navigation"><a href=1>Start</a></div><div class="cookie"><p>We use cookies, accept them.</p><button>OK</button></div><article><div><div>{main}</div></div></article><aside class="sidebar"><ul><li><a href=3>More news</a></li></ul></aside></body>',
]


def test_pages_of_other_layouts_and_without_marks():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    field = html_extract.Field().fit(html_extract.training_set([h for h, in rows[:80]]))
    exact = 0
    for i in range(24):
        texts = [f"{prose(40 * i + k, 20 + 9 * k).capitalize()}, as before." for k in range(2 + i % 4)]
        page = FOREIGN[i % 3].replace("{main}", "".join(f"<p>{t}</p>" for t in texts))
        exact += html_extract.main_text(page, field) == "\n\n".join(texts)
    assert exact >= 22
    found = wanted = right = 0
    for html, in rows[100:300]:
        labels = [html_extract._kept(b) for b in blocks(html)]
        bare = re.sub(r"<(/?)(?:article|main|nav|footer|header|aside)\b", r"<\1div", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html))
        got = field.decode(html_extract.features(blocks(bare)))
        assert len(got) == len(labels)
        found, wanted, right = found + sum(got), wanted + sum(labels), right + sum(bool(g) and k for g, k in zip(got, labels))
    assert right >= 0.98 * wanted and right >= 0.98 * found


def possible_totals(text, template):
    """How many words a Patience alignment may match, by its definition: edges, then each of the longest increasing choices of words unique to both, then gaps."""
    done = 0
    while text and template and text[0] == template[0]:
        text, template, done = text[1:], template[1:], done + 1
    while text and template and text[-1] == template[-1]:
        text, template, done = text[:-1], template[:-1], done + 1
    unique = [(text.index(w), j) for j, w in enumerate(template) if template.count(w) == 1 and text.count(w) == 1]
    chains = [c for n in range(len(unique), 0, -1) for c in itertools.combinations(unique, n) if all(x[0] < y[0] for x, y in itertools.pairwise(c))]
    totals = set()
    for chain in (c for c in chains if len(c) == len(chains[0])):
        sums = {done + len(chain)}
        for (i, j), (i2, j2) in itertools.pairwise([(-1, -1), *chain, (len(text), len(template))]):
            sums = {x + y for x in sums for y in possible_totals(text[i + 1:i2], template[j + 1:j2])}
        totals |= sums
    return totals or {done}


def test_alignment_against_its_definition():
    rng = random.Random(6)
    for _ in range(400):
        template = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 12))]
        text = [w for w in template if rng.random() > 0.2] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.5:
            rng.shuffle(text)
        got = license_scan.align(text, template)
        assert all(text[i] == template[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
        assert len(got) in possible_totals(text, template)


def test_field_is_a_crf():
    """Marginals and Viterbi against all labellings of a short page."""
    import numpy as np
    rng, field = np.random.default_rng(3), html_extract.Field()
    field.w, field.t = rng.normal(size=field.w.shape), rng.normal(size=(2, 2))
    page = html_extract.features(blocks("<h1>Title</h1><p>Some words, here.</p><div class=menu>Home</div><p>More.</p>"))
    scores = field.scores(page)
    weigh = lambda y: sum(scores[i][v] for i, v in enumerate(y)) + sum(field.t[a, b] for a, b in itertools.pairwise(y))
    ways = list(itertools.product((0, 1), repeat=len(page)))
    whole = sum(np.exp(weigh(y)) for y in ways)
    assert tuple(field.decode(page)) == max(ways, key=weigh)
    sure, _ = field.marginals(scores)
    assert np.allclose(sure[2, 1], sum(np.exp(weigh(y)) for y in ways if y[2]) / whole)


def test_held_out_pages_and_layouts(spark):
    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()
    field = html_extract.Field().fit(html_extract.training_set([h for _, _, h in rows[:60]]))
    right = total = 0
    rng = random.Random(9)
    for _, _, h in rows[60:160]:
        page = blocks(h)
        labels = [html_extract._kept(b) for b in page]
        right, total = right + sum(int(a == b) for a, b in zip(field.decode(html_extract.features(page)), labels)), total + len(page)
    assert right == total
    other = {"menu": ["Start", "Shop", "Contact us"], "notice": ["Accept our terms, and go on."], "side": ["Ten ways to cook rice"], "comments": ["Great read, thank you.", "I disagree with this."], "foot": ["© 2023 The Paper"]}
    for layout in html_extract.LAYOUTS:
        html, labels = html_extract.rendered([prose(1, 5), *[prose(i, 60).capitalize() + "." for i in range(2, 6)]], other, layout, rng)
        assert field.decode(html_extract.features(blocks(html))) == [int(x) for x in labels]


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", "<article><p>" + prose(1, 40000) + ".</p></article>", "x"), (None, "v", "no tags at all", "x")], "page_id long, url string, html string, row string")
    got = html_extract.extract(pages)
    unchanged(got, pages, "text", "n_chars")
    assert {r.page_id: r.n_chars for r in got.collect() if r.page_id in (1, 2)} == {1: 0, 2: 0}
    assert [r.n_chars for r in got.filter("page_id = 3").collect()] == [len(prose(1, 40000)) + 1]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x &amp; é</p><script>1</script><p>y</p>", "b"), (2, None, None, "b"), (1, "http://a/", "<p>x &amp; é</p><script>1</script><p>y</p>", "b"), (3, "http://b/", "z" * 100000, "b")], "page_id long, url string, html string, row string")
    sources = warc.responses(pages)
    assert set(sources.columns) == {"page_id", "row", *warc.F_NAMES}
    derived = warc.derive(sources)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    by_id = {r.record_id: r for r in sources.collect()}
    rows = derived.collect()
    assert len(rows) == 8 and {r.type for r in rows} == {"metadata", "conversion"}
    for r in rows:
        source = by_id[r.headers["WARC-Refers-To"]]
        payload = bytes(source.block).split(b"\r\n\r\n", 1)[1]
        assert (r.target_uri, r.headers["WARC-Refers-To-Date"], r.headers["WARC-Source-Payload-Digest"]) == (source.target_uri, source.date, sha1(payload))
        assert r.headers["WARC-Block-Digest"] == sha1(bytes(r.block)) and r.row == "b"
        if r.type == "metadata":
            assert f"source-header-content-length: {len(payload)}\r\n".encode() in bytes(r.block)
    assert sorted(bytes(r.block).decode() for r in rows if r.type == "conversion") == sorted(["x & é\ny", "", "x & é\ny", "z" * 100000])
    assert warc.derive(derived).count() == 0 and warc.derive(sources.limit(0)).count() == 0
    latin = [("<urn:x>", "response", "d", "u", {}, b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>\xe9"), ("<urn:y>", "response", "d", "u", {}, b"no head"), ("<urn:z>", "response", "d", None, None, None)]
    odd = warc.derive(spark.createDataFrame(latin, warc.RECORD)).filter("type = 'conversion'").collect()
    assert [bytes(r.block).decode() for r in odd] == ["é", "no head", ""]


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{prose(i)}</p>\r\n\r\n") for i in range(20)], "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages)).drop("page_id")
    warc.write_warc(records, str(tmp_path / "members"))
    members = [bytes(r.member) for r in spark.read.parquet(str(tmp_path / "members")).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:15]))
    (tmp_path / "b.warc").write_bytes(gzip.decompress(b"".join(members[15:])))
    back = warc.read_warc(spark, str(tmp_path / "*.warc*"))
    key = lambda r: (r.record_id, r.type, r.date, r.target_uri, sorted((k, v) for k, v in r.headers.items() if k != "Content-Length"), bytes(r.block))
    assert sorted(map(key, back.collect())) == sorted(map(key, records.collect()))
    with pytest.raises(StopIteration):
        next(warc.parse_records(b"not a record"))


def test_blocks_after_unread_elements_without_an_end_tag():
    for tag in ("<svg/>", '<svg class="a=b/"/>', "<svg hidden/>", "<math />", "<svg>", "<datalist><option>one<option value=b>two</datalist>", "<datalist><option>one <b>two</b></option><option>x</datalist>"):
        assert [b.text for b in blocks(f"<p>before</p>{tag}<p>The article.</p>")] == ["before", "The article."]
    assert [b.text for b in blocks("<p>a</p><svg class=x/>no text</svg><p>b</p><script>c<p>d</p>")] == ["a", "b"]


def test_damaged_warc_files_are_errors(spark, tmp_path):
    one = warc.serialised("resource", "<a>", "d", "u", {}, b"body")
    assert len(list(warc.parse_records(one + b"\r\n" + one[:-4], whole=True))) == 2
    for place, damaged in enumerate((one + b"x" + one, one + one[:-6], one + one[:20], b"no record")):
        with pytest.raises(ValueError, match="WARC record at byte"):
            list(warc.parse_records(damaged, whole=True))
        (tmp_path / f"{place}.warc").write_bytes(damaged)
        with pytest.raises(Exception, match="WARC record at byte"):
            warc.read_warc(spark, str(tmp_path / f"{place}.warc")).collect()


def test_license_query_returns_every_find(spark, tmp_path):
    text = f"Released under the MIT License. {prose(5, 300)} Licensed under CC BY-NC 4.0."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = QUERIES["op1_license_scan"](spark, str(tmp_path)).first()
    assert {f.license for f in row.finds} == set(row.licenses) == {"MIT", "CC-BY-NC-4.0"}
    assert sorted((f.first_word, f.last_word) for f in row.finds)[1][0] > 300 and all(f.coverage > 0 for f in row.finds)
