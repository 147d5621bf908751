import random

from pyspark.sql import functions as F

from leadweave.operators.dedup import first_seen
from leadweave.operators.discover import discover, page_links, pagination_stop, without_known
from leadweave.operators.lookups import check_domains, check_handles, handle_results, verify_handles
from leadweave.functions.urls import profile_link
from leadweave.operators.summary import handle_report, run_summary, verdict_counts
from tests.conftest import values


def test_repeated_identifier_is_kept_once(spark):
    rows = [(i, "  Lead@Example.COM ") for i in range(200)] + [(200, "   "), (201, "lead@example.com")]
    for parts in (1, 17):
        got = first_seen(spark.createDataFrame(rows, "ord long, id string").repartition(parts), "id", ["ord"])
        assert values(got, "ord", "id") == [(0, "  Lead@Example.COM ")]


PAGES_1 = [(0, "c", 1, '<a href="/alpha">A</a><a href="/categories">x</a><a href="/ALPHA">dup</a>'), (0, "c", 2, '<a href="/beta?x=1">B</a><a href="https://other.example/z">o</a>'), (0, "c", 3, "<p>none</p>"), (0, "c", 4, '<a href="/late">L</a>')]
PAGES_2 = [(0, "g", 1, '<a href="/shared"></a>'), (0, "g", 2, '<a href="/gambling-two"></a><a href="/shared"></a>'), (0, "g", 3, '<a href="/shared"></a>'),
           (1, "k", 1, '<a href="/shared"></a>'), (1, "k", 2, "<a href='/crypto-two'></a><!-- <a href='/hidden'></a> -->")]


def _links(spark, pages, clean=None):
    df = spark.createDataFrame([(c, f"https://dir.example/{u}?page={n}", n, h) for c, u, n, h in pages], "cat_ord int, url string, page_no int, html string")
    return page_links(df, **({"clean": clean} if clean else {})).select("cat_ord", "page_no", "pos", "link")


def _ordered(df):
    return [r.link.rsplit("/", 1)[1] for r in df.orderBy("cat_ord", "page_no", "pos").collect()]


def test_cards_across_pages_and_categories(spark):
    assert _ordered(discover(_links(spark, PAGES_1))) == ["alpha", "beta"]
    assert _ordered(discover(_links(spark, PAGES_2))) == ["shared", "gambling-two", "crypto-two"]


def test_known_profiles_are_skipped_after_the_stop(spark):
    pages = [(0, "networks/", 1, '<a href="/network/alpha"></a><a href="/networks/"></a>'), (0, "networks/", 2, '<a href="/network/beta?ref=d"></a><a href="/network/alpha"></a>'), (0, "networks/", 3, "none")]
    found = discover(_links(spark, pages, profile_link))
    assert _ordered(found) == ["alpha", "beta"]
    known = spark.createDataFrame([("https://dir.example/network/alpha",)], "source_url string")
    assert _ordered(without_known(found, known)) == ["beta"]


def test_discovery_against_the_loop(spark):
    rng = random.Random(5)
    for round_ in range(4):
        rows = [(c, p, i, f"l{rng.randint(0, 25)}") for c in range(5) for p in range(1, 9) if rng.random() > 0.1 for i in range(rng.randint(0, 4))]
        want, seen = [], set()
        for c in range(5):
            mine, page = set(), 1
            while True:
                links = [r for r in rows if r[0] == c and r[1] == page]
                fresh = 0
                for r in links:
                    if r[3] in mine:
                        continue
                    mine.add(r[3])
                    fresh += 1
                    if r[3] not in seen:
                        seen.add(r[3])
                        want.append(r)
                if not fresh:
                    break
                page += 1
        df = spark.createDataFrame(rows, "cat_ord int, page_no int, pos int, link string")
        got = sorted(values(discover(df.repartition(round_ + 1)), "cat_ord", "page_no", "pos", "link"))
        assert got == sorted(want)
        assert pagination_stop(df).filter("last_page is null").count() == 0


def _snapshot(spark):
    rows = [("available", 7, False, False, True, ""), ("gone", 8, False, True, False, ""), ("bot", 9, True, False, False, ""), ("bad", None, None, None, None, "X USERNAME_INVALID"), ("free", None, None, None, None, "rpc: USERNAME_NOT_OCCUPIED"), ("empty", None, None, None, None, "")]
    return spark.createDataFrame(rows, "handle string, user_id long, is_bot boolean, is_deleted boolean, was_verified boolean, error_code string")


def test_verdicts(spark):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(["@Available", "gone", "bot", "bad", "free", "empty", "missing", "  "])], "id long, handle string")
    got = check_handles(rows, _snapshot(spark), "handle").orderBy("id").select("verdict.*")
    assert values(got, "status", "user_id", "is_deleted") == [("VALID", 7, False), ("DELETED", 8, True), ("VALID", 9, False), ("INVALID", 0, False), ("NOT_FOUND", 0, False), ("NOT_FOUND", 0, False), ("NOT_FOUND", 0, False), ("INVALID", 0, False)]


def _leads(spark, handles):
    return spark.createDataFrame([(i, (["a@b.example"], h)) for i, h in enumerate(handles)], "id long, contacts struct<emails:array<string>,telegram:array<string>>")


def test_unusable_handles_are_dropped_but_reported(spark):
    leads = verify_handles(_leads(spark, [["missing", "available"], []]), _snapshot(spark)).orderBy("id").collect()
    assert leads[0].contacts.telegram == ["available"]
    assert [(r.username, r.status) for r in leads[0].tg_results] == [("missing", "NOT_FOUND"), ("available", "VALID")]
    assert leads[1].contacts.telegram == [] and leads[1].tg_results == []


def test_no_snapshot_means_skipped(spark):
    lead = verify_handles(_leads(spark, [["missing", "available"]])).first()
    assert {r.status for r in lead.tg_results} == {"SKIPPED"} and lead.contacts.telegram == ["missing", "available"]


def test_hot_handle_is_spread_and_whole(spark):
    leads = _leads(spark, [["available", f"h{i}"] if i % 3 else ["available"] for i in range(300)])
    results = handle_results(leads, _snapshot(spark))
    c = verdict_counts(results).first()
    assert (c.extracted, c.valid, c.not_found) == (500, 300, 200)


def test_hot_handle_join_is_split_by_aqe(spark):
    facts = spark.range(200000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("handle"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = check_handles(facts, spark.createDataFrame([("hot", 1, False, False, False, "")] * 2, "handle string, user_id long, is_bot boolean, is_deleted boolean, was_verified boolean, error_code string"), "handle")
        rows = joined.select("id", "verdict.user_id").collect()
        assert len(rows) == 200000 and sum(r.user_id == 1 for r in rows) == sum(i % 3 > 0 for i in range(200000))
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_mail_domains(spark):
    mx = spark.createDataFrame([("cached.invalid", 1, "ok"), ("slow.example", 0, "timeout"), ("dead.example", 0, "error"), ("none.example", 0, "ok")], "domain string, n_mx long, outcome string")
    rows = spark.createDataFrame([(0, "nope"), (1, "user@Cached.Invalid"), (2, "a@slow.example"), (3, "a@dead.example"), (4, "a@none.example"), (5, "a@unknown.example")], "id long, email string")
    assert values(check_domains(rows, mx, "email").orderBy("id"), "mx_ok") == [False, True, True, False, False, False]


def test_summary_percentages(spark):
    leads = spark.createDataFrame([(True,), (False,), (False,)], "is_cis boolean")
    s = run_summary(spark.range(5), leads).first()
    assert (s.targets, s.leads, s.flagged, s.unflagged, s.flagged_pct, s.unflagged_pct) == (5, 3, 1, 2, 33.3, 66.7)
    none = run_summary(spark.range(2), leads.filter("false")).first()
    assert (none.targets, none.leads, none.flagged_pct) == (2, 0, 0.0)


def test_handle_report_keeps_duplicates(spark):
    rows = spark.createDataFrame([(0, "available"), (1, "t.me/available"), (2, "missing")], "ord long, handle string")
    assert values(handle_report(rows, _snapshot(spark), "handle", ["ord"]).orderBy("ord"), "username", "status", "user_id") == [("available", "VALID", 7), ("available", "VALID", 7), ("missing", "NOT_FOUND", 0)]
