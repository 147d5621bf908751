"""Queries over HTML pages, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle_parts as o
from catalog.derived import ctes, derived
from catalog.text_queries import _long, query
from leadweave.functions.rules import MailRules, classify
from leadweave.functions.text import collapse_space, extract_contacts
from leadweave.functions.urls import lead_id
from leadweave.operators.network import key_value_pairs, key_value_rows, manager_blocks, metadata, network_records, page_structure
from leadweave.operators.tokens import visible_markup
from leadweave.plans.leads import company_name, first_targets, leads_from_pages, page_title, rejects, run_leads, scanned_text, with_layout
from leadweave.session import spread


def _routed(spark, sf):
    return spread(with_layout(derived(spark, sf, "directory_pages"), derived(spark, sf, "routes")))


_ROUTED = f"routed AS (SELECT p.*, coalesce(r.layout, 'default') AS layout FROM profile_pages p LEFT JOIN routes r ON r.host = {o.route_host('p.url')})"
# what the irregular pages say, from the table they are made of
_OLD = ("old AS (SELECT 10000000 + s_suppkey AS page_id, s_suppkey AS n, s_nationkey AS k, s_suppkey % 6 AS kind, "
        "CASE CAST(floor(s_suppkey / 6) AS BIGINT) % 2 WHEN 0 THEN 'A' ELSE 'B' END AS layout FROM supplier)")
_WITH_ROUTED = ctes("profile_pages", "routes") + ", " + _ROUTED + ", " + _OLD + " "
# the profile pages are regular, so plain patterns find what the element rules find
_ROWS = "SELECT page_id, layout, unnest(regexp_extract_all(html, '<tr><th>(.*?)</th><td>(.*?)</td></tr>', 1)) AS label, unnest(regexp_extract_all(html, '<tr><th>(.*?)</th><td>(.*?)</td></tr>', 2)) AS value FROM routed WHERE layout <> 'default'"


def _untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


@query("q_page_title", f"SELECT page_id, {o.trim(o.decode('regexp_extract(html, ' + chr(39) + '(?is)<title>(.*?)</title>' + chr(39) + ', 1)'))} AS title FROM pages")
def q_page_title(spark, sf):
    pages = spread(derived(spark, sf, "pages")).select("page_id", visible_markup("html").alias("markup"))
    return pages.select("page_id", page_title("markup").alias("title"))


_TITLE = o.trim(o.decode("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))
_H1 = f"nullif({o.trim(o.decode(_untag('regexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)')))}, '')"
_OG = "nullif(regexp_extract(html, '<meta property=\"og:title\" content=\"([^\"]*)\">', 1), '')"
_COMPANY = f"CASE layout WHEN 'A' THEN coalesce({_H1}, {_TITLE}) WHEN 'B' THEN coalesce({_H1}, {_OG}, {_TITLE}) ELSE {_TITLE} END"


@query("q_company_name", ctes("laid_out") + f" SELECT src, page_id, layout, {_COMPANY} AS company_name FROM laid_out")
def q_company_name(spark, sf):
    pages = spread(derived(spark, sf, "laid_out")).select("src", "page_id", "layout", visible_markup("html").alias("markup"))
    return pages.select("src", "page_id", "layout", company_name("markup", "layout").alias("company_name"))


_OLD_ROWS = """
 SELECT page_id, 1 AS pos, 'Minimum payout' AS label, '$' || n AS value FROM old WHERE kind = 0 UNION ALL SELECT page_id, 2, 'Payment Frequency', 'Net ' || k FROM old WHERE kind = 0
 UNION ALL SELECT page_id, 1, 'Payment terms', 'Weekly ' || k FROM old WHERE kind = 1
 UNION ALL SELECT page_id, 1, 'Commission TypeCPS ' || k, 'Commission Type' FROM old WHERE kind = 2 UNION ALL SELECT page_id, 2, 'Commission Type', 'CPS ' || k FROM old WHERE kind = 2
 UNION ALL SELECT page_id, 1, 'Referral rate', '5%' FROM old WHERE kind = 5 UNION ALL SELECT page_id, 2, 'referral', k || '%' FROM old WHERE kind = 5
 UNION ALL SELECT page_id, 3, 'Minimum payout', '' FROM old WHERE kind = 5"""
_OLD_PAIRS = """
 SELECT page_id, 11 AS pos, 'Payout model' AS label, 'RevShare ' || k AS value FROM old WHERE kind = 3 UNION ALL SELECT page_id, 12, 'Referral', 'Minimum payout' FROM old WHERE kind = 3
 UNION ALL SELECT page_id, 13, 'Minimum payout', n || ' USD' FROM old WHERE kind = 3"""
_KV = f"SELECT page_id, {o.collapse(_untag('label'))} AS label, {o.collapse(_untag('value'))} AS value FROM ({_ROWS})"
_KP = ("SELECT page_id, regexp_extract(html, '<dt>(.*?)</dt><dd>(.*?)</dd>', 1) AS label, regexp_extract(html, '<dt>(.*?)</dt><dd>(.*?)</dd>', 2) AS value "
       "FROM routed WHERE layout <> 'default'")


def _structure(spark, sf):
    return page_structure(_routed(spark, sf).filter("layout <> 'default'"))


@query("q_kv_rows", _WITH_ROUTED + f"{_KV} UNION ALL SELECT page_id, label, value FROM ({_OLD_ROWS})")
def q_kv_rows(spark, sf):
    rows = _structure(spark, sf).select("page_id", F.explode(key_value_rows(F.col("marks"), F.col("texts"))).alias("p"))
    return rows.select("page_id", collapse_space("p.label").alias("label"), collapse_space("p.value").alias("value"))


@query("q_kv_pairs", _WITH_ROUTED + f"{_KP} UNION ALL SELECT page_id, label, value FROM ({_OLD_PAIRS})")
def q_kv_pairs(spark, sf):
    rows = _structure(spark, sf).select("page_id", F.explode(key_value_pairs(F.col("marks"), F.col("texts"))).alias("p"))
    return rows.select("page_id", collapse_space("p.label").alias("label"), collapse_space("p.value").alias("value"))


_FIELDS_OF = ", ".join(f"coalesce(arg_max(value, pos) FILTER (field = '{f}' AND value <> ''), '') AS {f}" for f in ("commission_type", "payment_frequency", "minimum_payout", "referral_rate"))
_META = f"""SELECT page_id, {_FIELDS_OF} FROM (
 SELECT page_id, pos, value, CASE WHEN contains(lower(label), 'commission') OR contains(lower(label), 'payout model') THEN 'commission_type'
 WHEN contains(lower(label), 'frequency') OR contains(lower(label), 'payment terms') THEN 'payment_frequency' WHEN contains(lower(label), 'minimum') AND contains(lower(label), 'payout') THEN 'minimum_payout'
 WHEN contains(lower(label), 'referral') THEN 'referral_rate' END AS field
 FROM (SELECT page_id, 0 AS pos, label, value FROM ({_KV} UNION ALL {_KP}) UNION ALL {_OLD_ROWS} UNION ALL {_OLD_PAIRS} UNION ALL SELECT page_id, 0, '', '' FROM old)) GROUP BY page_id"""


@query("q_network_metadata", _WITH_ROUTED + _META)
def q_network_metadata(spark, sf):
    found = _structure(spark, sf).select("page_id", metadata(key_value_rows(F.col("marks"), F.col("texts")), key_value_pairs(F.col("marks"), F.col("texts"))).alias("m"))
    return found.select("page_id", "m.*")


_BLOCKS = f"""SELECT page_id, 1 AS block, {o.collapse(_untag("label || value"))} AS text, value AS markup FROM ({_ROWS}) WHERE label = 'Affiliate Manager'
 UNION ALL SELECT page_id, 2 AS block, {o.collapse(_untag("regexp_extract(html, '<li>(.*?)</li>', 1)"))} AS text, regexp_extract(html, '<li>(.*?)</li>', 1) AS markup FROM routed WHERE layout <> 'default' AND contains(html, '<li>')"""


# name, emails and skype of each block; a later block of the same name ignoring case is merged into the first
_OLD_BLOCKS = """
 SELECT page_id, 1 AS block, 'Account Manager: stray ' || n || 'Payment termsWeekly ' || k AS text FROM old WHERE kind = 1
 UNION ALL SELECT page_id, 1, 'Affiliate Manager: Joe ' || k || 'Commission TypeCPS ' || k || 'x' FROM old WHERE kind = 2 UNION ALL SELECT page_id, 2, 'Affiliate Manager: Joe ' || k FROM old WHERE kind = 2
 UNION ALL SELECT page_id, 1, 'Network contact: Ann ' || n || ' c' FROM old WHERE kind = 3 AND layout = 'B' UNION ALL SELECT page_id, 2, 'network CONTACT ANN ' || n FROM old WHERE kind = 3 AND layout = 'B'
 UNION ALL SELECT page_id, 1, 'Account manager Eve ' || n FROM old WHERE kind = 4 UNION ALL SELECT page_id, 2, 'Affiliate manager Zoe' FROM old WHERE kind = 4"""
_OLD_MANAGERS = """
 SELECT page_id, 0 AS pos, 'Account Manager' AS name, '' AS emails, '' AS skype, '' AS telegram FROM old WHERE kind = 1
 UNION ALL SELECT page_id, 0, 'Joe ' || k, '', '', '' FROM old WHERE kind = 2
 UNION ALL SELECT page_id, 0, 'Ann ' || n, 'ann@x.example,bob@x.example', 'skype:ann.' || k, '' FROM old WHERE kind = 3 AND layout = 'B'
 UNION ALL SELECT page_id, 0, 'Eve ' || n, '', '', '' FROM old WHERE kind = 4 UNION ALL SELECT page_id, 1, 'Affiliate manager Zoe', '', '', '' FROM old WHERE kind = 4"""


@query("q_manager_blocks", _WITH_ROUTED + f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS pos, text FROM (SELECT page_id, block, text FROM ({_BLOCKS}) UNION ALL {_OLD_BLOCKS})")
def q_manager_blocks(spark, sf):
    found = _structure(spark, sf).select("page_id", F.posexplode(manager_blocks(F.col("marks"), F.col("texts"), F.col("layout"))).alias("pos", "b"))
    return found.select("page_id", "pos", "b.text")


_MANAGERS = f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block) - 1 AS pos,
 CASE block WHEN 1 THEN regexp_extract(markup, '<span class="manager-name">(.*?)</span>', 1) ELSE trim(split_part(text, ':', 1)) END AS name,
 CASE block WHEN 1 THEN lower(regexp_extract(markup, 'data-email="([^"]*)"', 1)) ELSE regexp_extract(markup, 'mailto:([^"]*)"', 1) END AS emails, '' AS skype,
 CASE block WHEN 1 THEN regexp_extract(markup, 't\\.me/([a-z0-9_]+)', 1) ELSE '' END AS telegram FROM ({_BLOCKS})"""


@query("q_managers", _WITH_ROUTED + f"{_MANAGERS} UNION ALL {_OLD_MANAGERS}")
def q_managers(spark, sf):
    found = network_records(_routed(spark, sf).filter("layout <> 'default'")).select("page_id", F.posexplode("network.managers").alias("pos", "m"))
    return found.select("page_id", "pos", "m.name", *[F.array_join(f"m.{c}", ",").alias(c) for c in ("emails", "skype", "telegram")])


_META_CONTENT = "array_to_string(regexp_extract_all(html, '<meta [^>]*content=\"([^\"]*)\"', 1), ' ')"
_SCANNED = f"CASE layout WHEN 'B' THEN concat_ws(' ', {o.decode('html', False)}, {_META_CONTENT}) ELSE {o.decode('html', False)} END"


@query("q_page_contacts", ctes("laid_out") + f", scanned AS (SELECT src, page_id, {_SCANNED} AS raw FROM laid_out) " + o.contacts_long("scanned", "src, page_id"))
def q_page_contacts(spark, sf):
    pages = spread(derived(spark, sf, "laid_out")).select("src", "page_id", scanned_text("html", "layout", visible_markup("html")).alias("raw"))
    return _long(pages.select("src", "page_id", extract_contacts("raw").alias("contacts")), ["src", "page_id"])


_ALL_PAGES = f"""all_pages AS (SELECT page_id, url, html, layout FROM routed UNION ALL SELECT page_id, url, html, layout FROM old_pages JOIN old USING (page_id) UNION ALL SELECT 1000000000 + page_id AS page_id, url, html, 'default' AS layout FROM pages)"""


def _joined(kind: str) -> str:
    return f"SELECT page_id, string_agg(value, ',' ORDER BY pos) AS {kind} FROM ({o.contacts(kind, 'scanned', 'page_id')}) GROUP BY page_id"


@query("q_leads_from_pages", ctes("profile_pages", "old_pages", "routes") + f""", {_ROUTED}, {_OLD}, {_ALL_PAGES}, scanned AS (SELECT page_id, {_SCANNED} AS raw FROM all_pages), mails AS ({_joined('emails')}), tgs AS ({_joined('telegram')}),
 meta AS ({_META}), managers AS (SELECT page_id, string_agg(name, ',' ORDER BY pos) AS managers, string_agg(emails, ',' ORDER BY pos) AS manager_emails FROM ({_MANAGERS} UNION ALL {_OLD_MANAGERS}) GROUP BY page_id),
 reasons AS (SELECT page_id, arg_min(reason, pos) AS reason FROM (SELECT page_id, pos, {o.mail_reason('value', False)} AS reason FROM ({o.contacts('emails', 'scanned', 'page_id')})) WHERE reason IS NOT NULL GROUP BY page_id)
 SELECT p.page_id, sha256(p.url) AS id, p.url AS source_url, p.layout, {_COMPANY} AS company_name, coalesce(mails.emails, '') AS emails, coalesce(tgs.telegram, '') AS telegram,
 meta.commission_type, meta.minimum_payout, meta.referral_rate, CASE WHEN layout <> 'default' THEN coalesce(managers.managers, '') END AS managers,
 CASE WHEN layout <> 'default' THEN coalesce(managers.manager_emails, '') END AS manager_emails, coalesce(reasons.reason, '') AS cis_reason
 FROM all_pages p LEFT JOIN mails USING (page_id) LEFT JOIN tgs USING (page_id) LEFT JOIN meta USING (page_id) LEFT JOIN managers USING (page_id) LEFT JOIN reasons USING (page_id)""")
def q_leads_from_pages(spark, sf):
    captured = derived(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("page_id"), "url", "html")
    pages = spread(derived(spark, sf, "directory_pages").unionByName(captured))
    leads = classify(leads_from_pages(pages, derived(spark, sf, "routes")), MailRules(), None)
    return leads.select(
        "page_id", "id", "source_url", "layout", "company_name", F.array_join("contacts.emails", ",").alias("emails"), F.array_join("contacts.telegram", ",").alias("telegram"),
        "network.commission_type", "network.minimum_payout", "network.referral_rate", F.array_join("network.managers.name", ",").alias("managers"),
        F.array_join(F.transform("network.managers", lambda m: F.array_join(m["emails"], ",")), ",").alias("manager_emails"), "cis_reason")


_TARGETS = "targets AS (SELECT ord AS page_id, line AS url FROM target_lines UNION ALL SELECT page_id + 2000000, NULL FROM pages WHERE page_id % 50 = 0)"
_TARGET_KEY = f"coalesce(lower({o.trim('url')}), '')"


@query("q_rejects", ctes("target_lines") + f""", {_TARGETS}, firsts AS (SELECT min(page_id) AS page_id FROM targets GROUP BY {_TARGET_KEY})
 SELECT page_id, url, 'route' AS stage, 'target URL "' || coalesce(url, '') || '" must include a scheme and host' AS reason FROM targets WHERE coalesce({o.route_host('url')}, '') = '' AND page_id IN (SELECT page_id FROM firsts)""")
def q_rejects(spark, sf):
    missing = derived(spark, sf, "pages").filter("page_id % 50 = 0").select((F.col("page_id") + 2000000).alias("page_id"), F.lit(None).cast("string").alias("url"))
    targets = derived(spark, sf, "target_lines").select(F.col("ord").alias("page_id"), F.col("line").alias("url")).unionAll(missing)
    return rejects(targets, first_targets(targets))


# targets of every kind: unusable URLs, pages that were not captured, handles that could not be looked up, ids taken by other URLs
_STAGES = """fates AS (SELECT s_suppkey AS page_id, CASE s_suppkey % 7 WHEN 0 THEN 'no scheme' ELSE 'https://stage.example/' END || s_suppkey AS url, s_suppkey % 7 AS kind FROM supplier)
 SELECT page_id, url, CASE kind WHEN 0 THEN 'route' WHEN 1 THEN 'extract' WHEN 2 THEN 'lookup' ELSE 'write' END AS stage,
 CASE kind WHEN 0 THEN 'target URL "' || url || '" must include a scheme and host' WHEN 1 THEN 'the page was not captured' WHEN 2 THEN 'handle "busy_handle": too many requests' ELSE 'the id belongs to https://elsewhere.example/' END AS reason
 FROM fates WHERE kind < 4"""


@query("q_reject_stages", "WITH " + _STAGES)
def q_reject_stages(spark, sf):
    kind = F.col("s_suppkey") % 7
    pages = spread(derived(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("page_id"), F.concat(F.when(kind == 0, "no scheme").otherwise("https://stage.example/"), "s_suppkey").alias("url"),
        F.when(kind != 1, F.concat(F.lit("<title>S</title>"), F.when(kind == 2, "@busy_handle").otherwise("@free_handle"))).alias("html"))
    snapshot = spark.sql("SELECT handle, 1L AS user_id, false AS is_bot, false AS is_deleted, false AS was_verified, '' AS error_code, error AS lookup_error FROM VALUES ('busy_handle', 'too many requests'), ('free_handle', NULL) AS t(handle, error)")
    stored = pages.filter(F.col("page_id") % 7 == 3).select(lead_id("url").alias("id"), F.lit("https://elsewhere.example/").alias("source_url"))
    return run_leads(pages, mail=MailRules(), names=None, handle_snapshot=snapshot, stored_leads=stored).rejects
