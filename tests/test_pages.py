import random
import re

import pytest
from pyspark.sql import functions as F

from leadweave.functions.rules import MailRules
from leadweave.functions.urls import lead_id
from leadweave.operators import page_tree
from leadweave.operators.network import key_value_pairs, key_value_rows, manager_blocks, network_records, page_structure
from leadweave.operators.tokens import page_tokens, visible_markup
from leadweave.plans.leads import company_name, first_targets, leads_from_pages, page_title, run_leads
from leadweave.session import scratch_dir
from tests import tree
from tests.conftest import values

PAGE_A = """<html><head><title>Directory entry 12</title></head><body><div class=top><h1>Larkspur <em>Media</em></h1></div>
<div><table><tbody><tr><td>Commission Type<td>Sale, Lead<tr><td>Payment frequency<td>Twice a month<tr><td>Minimum payout<td>40 EUR<tr><td>Referral<td>none</table></div>
<ul><li>Account manager: <b class="x name">Ola Nordin</b> <a title="ola@larkspur.example" href="mailto:ola@larkspur.example">write</a>
<li>Account manager: <b class="name y">OLA NORDIN</b> <i data-tippy="skype:ola.n">call</i></ul>
<p data-email="desk@larkspur.example">Also @larkspur_desk</p></body>"""
PAGE_B = """<head><meta content="Quillwort Partners" property="og:title"><title>Entry</title></head>
<dl><dt>Minimum payout<dd>15<dt>Commission type<dd>Flat</dl>
<table><tr><th>Network Contact</th><td><span class=manager-name>Per Lind</span> skype:per.lind <a href="//t.me/per_lind_q" title="per@quillwort.example">chat</a></td></tr></table>"""


def test_directory_pages(spark):
    pages = spark.createDataFrame([(1, "https://affpaying.com/n/12", PAGE_A), (2, "https://www.offervault.com/network/q", PAGE_B), (3, "https://else.example/", PAGE_A)], "page_id long, url string, html string")
    a, b, c = leads_from_pages(pages).orderBy("page_id").collect()
    assert a.company_name == a.raw_name == "Larkspur Media" and c.company_name == "Directory entry 12" and c.network is None
    assert sorted(a.contacts.emails) == ["desk@larkspur.example", "ola@larkspur.example"] and a.contacts.telegram == ["larkspur_desk"]
    n = a.network
    assert (n.commission_type, n.payment_frequency, n.minimum_payout) == ("Sale, Lead", "Twice a month", "40 EUR")
    assert [(m.name, m.emails, m.skype) for m in n.managers] == [("Ola Nordin", ["ola@larkspur.example"], ["skype:ola.n"])]
    assert b.company_name == "Quillwort Partners" and b.contacts.emails == ["per@quillwort.example"] and b.contacts.telegram == ["per_lind_q"]
    assert (b.network.commission_type, b.network.minimum_payout, [m.name for m in b.network.managers]) == ("Flat", "15", ["Per Lind"])


def test_pages_of_one_id_are_refused(spark):
    pages = spark.createDataFrame([(1, "https://a.example", "<title>A</title>"), (1, "https://b.example", "<title>B</title>")], "page_id long, url string, html string")
    with pytest.raises(ValueError, match="page_id 1"):
        run_leads(pages, mail=MailRules(), names=None)


def test_tokens_give_the_page_back(spark):
    rng = random.Random(3)
    pages = [tree.random_page(rng) for _ in range(50)] + ["a < b <c <!-- x", "<p title='>'>x</p", "</ y><?x><!doctype html><script>a", ""]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert df.filter(F.array_join(page_tokens("html"), "") != F.col("html")).count() == 0


def test_elements_against_a_tree(spark):
    rng = random.Random(11)
    pages = [tree.random_page(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, "A", p) for i, p in enumerate(pages)], "page_id long, layout string, html string")
    m, t, lay = F.col("marks"), F.col("texts"), F.col("layout")
    got = page_structure(df).select("page_id", key_value_rows(m, t).alias("rows"), key_value_pairs(m, t).alias("pairs"), manager_blocks(m, t, lay).alias("blocks")).collect()
    assert len(got) == len(pages)
    phrases = ("affiliate manager", "account manager")
    n = 0
    for r in got:
        page = tree.Tree(pages[r.page_id])
        assert [(p.label, p.value) for p in r.rows] == tree.kv_rows(page), pages[r.page_id]
        assert [(p.label, p.value) for p in r.pairs] == tree.kv_pairs(page), pages[r.page_id]
        assert [b.text for b in r.blocks or []] == [tree.squash(b.text()) for b in tree.blocks(page, phrases)], pages[r.page_id]
        n += len(r.blocks or [])
    assert n > 50
    records = {r.page_id: r.network for r in network_records(df).collect()}
    for i, html in enumerate(pages):
        names = [name for name in map(tree.block_name, tree.blocks(tree.Tree(html), phrases)) if name]
        firsts: dict = {}
        for name in names:
            firsts.setdefault(name.lower(), name)
        assert [x.name for x in records[i].managers] == list(firsts.values()), html


def test_managers_are_merged_by_name_and_refilled(spark):
    html = ('<ul><li>Account manager <b>Joe</b> <a href="mailto:a@x.example">m</a></li><li>account manager <b>JOE</b><i title="b@x.example A@x.example"></i></li>'
            '<li>Account manager: <b>skype:zed</b></li></ul>')
    df = spark.createDataFrame([(1, "A", html)], "page_id long, layout string, html string")
    got = network_records(df).first().network.managers
    assert [(m.name, m.emails, m.skype) for m in got] == [("Joe", ["a@x.example", "b@x.example"], []), ("skype:zed", [], ["skype:zed"])]


def test_scanned_text_decodes_all_but_script_bodies(spark):
    html = '<p title="&#64;in_attribute">&commat;in_text</p><!-- &#64;in_comment --><script>"&#64;in_script @raw_script"</script><textarea>&#64;in_area</textarea>'
    pages = spark.createDataFrame([(1, "https://else.example/", html)], "page_id long, url string, html string")
    assert leads_from_pages(pages).first().contacts.telegram == ["in_attribute", "in_text", "in_comment", "raw_script", "in_area"]


def test_title_picks(spark):
    rows = [("A", "<title>T</title><h1> </h1>", "T"), ("A", "<!-- <h1>no</h1> --><h1>a <i>b</i> &amp; c</h1><h1>d</h1>", "a b & c"), ("B", '<title>T</title><meta content="OG &quot;x&quot;" property="og:title">', 'OG "x"'),
            ("B", "<title> T </title><h1></h1>", "T"), ("default", "<title> </title><h1>H</h1><svg><title>S</title></svg>", "S"), ("default", "<script>'<title>x</title>'</script><TITLE lang=en>A&lt;b&gt;</TITLE>", "A<b>"), ("default", "none", "")]
    df = spark.createDataFrame(rows, "layout string, html string, want string").select(company_name(visible_markup("html"), "layout").alias("got"), "want")
    assert [r for r in values(df, "got", "want") if r[0] != r[1]] == []
    assert page_title is not None


def test_run_goes_on_after_a_bad_target(spark):
    rows = [(0, "https://first.example/p", "<title>First</title>@one_desk"), (1, "no scheme here", "x"), (2, "https://next.example/p", "<title>Next</title>@one_desk a@b.example"), (3, "HTTPS://first.example/P ", "<title>Late</title>"), (4, " NO scheme here", "x"),
            (5, None, "x"), (6, "  ", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 5):
        run = run_leads(pages.repartition(parts), mail=MailRules(), names=None)
        assert sorted(values(run.leads, "company_name")) == ["First", "Next"]
        assert sorted(values(run.rejects, "page_id", "stage")) == [(1, "route"), (5, "route")]
        s = run.summary.first()
        assert (s.targets, s.leads, s.handles_checked, s.skipped) == (7, 2, 2, 2)


def test_plan_reads_the_html_once_and_moves_none(spark):
    pages = spark.createDataFrame([(0, "https://a.example", "x")], "page_id long, url string, html string")
    path = scratch_dir(spark, "pages")
    pages.write.parquet(path)
    pages = spark.read.parquet(path)
    plan = leads_from_pages(pages, winners=first_targets(pages))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("html" in s.split("Batched")[0] for s in scans) == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # pages stay where they are: nothing but the few ids of repeated targets moves, and only tag codes go through Python
    assert [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line] == []
    assert "Sort" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    assert "build(" in plan and not re.search(r"build\([^)]*html", plan)
    snapshot = spark.sql("SELECT 'h' AS handle, 1 AS user_id, false AS is_bot, false AS is_deleted, false AS was_verified, '' AS error_code")
    run = run_leads(pages, mail=MailRules(), names=None, handle_snapshot=snapshot, mx_snapshot=spark.sql("SELECT 'd' AS domain, 1 AS n_mx, 'ok' AS outcome"))
    for df in (run.leads, run.summary):
        assert "html" not in df._jdf.queryExecution().executedPlan().toString().replace("html5", "")
    assert run.leads.count() == 1


def test_failures_of_every_stage_become_rows(spark, monkeypatch):
    rows = [(0, "https://good.example/", "<title>Good</title>@fine_handle"), (1, "nowhere", "x"), (2, "https://gone.example/", None), (3, "https://busy.example/", "<title>B</title>@busy_handle @fine_handle"),
            (4, "https://taken.example/", "<title>T</title>"), (5, "https://good.example/", "<title>Late</title>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    snapshot = spark.createDataFrame([("fine_handle", 5, None), ("busy_handle", None, "try later")], "handle string, user_id long, lookup_error string").selectExpr(
        "*", "false AS is_bot", "false AS is_deleted", "false AS was_verified", "'' AS error_code")
    stored = pages.filter("page_id IN (0, 4)").select(lead_id("url").alias("id"), F.when(F.col("page_id") == 4, "https://other.example/").otherwise(F.col("url")).alias("source_url"))
    run = run_leads(pages, mail=MailRules(), names=None, handle_snapshot=snapshot, stored_leads=stored)
    assert values(run.leads, "company_name") == ["Good"] and not {"failure", "taken", "lookup_error", "page_error"} & set(run.leads.columns)
    assert sorted(values(run.rejects, "page_id", "stage", "reason")) == [
        (1, "route", 'target URL "nowhere" must include a scheme and host'), (2, "extract", "the page was not captured"), (3, "lookup", 'handle "busy_handle": try later'),
        (4, "write", "the id belongs to https://other.example/")]
    s = run.summary.first()
    assert (s.targets, s.leads, s.handles_checked) == (6, 3, 3)


def test_a_page_that_cannot_be_read_is_one_error(monkeypatch):
    monkeypatch.setattr(page_tree, "tree_of", lambda codes: 1 / 0 if codes == "bad" else {n: [] for n in page_tree.FIELDS})
    assert [page_tree._tree_or_error(c)["error"] for c in ("bad", "#")] == ["ZeroDivisionError: division by zero", None]
