"""Input tables derived from the given ones. The SQL text is the same for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

DERIVED = {
    "contact_notes": """
SELECT s_suppkey AS note_id,
       concat(CASE s_suppkey % 4 WHEN 0 THEN 'Ivan Petrenko' WHEN 1 THEN 'Alice Smith' WHEN 2 THEN 'Justin Main' ELSE 'Bitcoin Plugin' END) AS raw_name,
       concat('Write to ', CASE s_suppkey % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'Anna.Sales' ELSE 'user' END, '@Mail', s_suppkey % 9,
              CASE s_suppkey % 5 WHEN 0 THEN '.example.ru' WHEN 1 THEN '.ukr.net' ELSE '.example.com' END,
              ', logo@2x.png, https://t.me/Handle_', s_suppkey % 40, ', @Handle_', s_suppkey % 25, ', @share, about.me/profile', s_suppkey % 7,
              '. x.com/Brand_', s_suppkey % 11, ', x.com/intent. https://www.linkedin.com/in/Person-', s_suppkey % 13,
              ' skype:sk.', s_suppkey % 6, ', live:lv', s_suppkey % 6, '. discord.gg/Inv', s_suppkey % 8, ' and name', s_suppkey % 8, '#', 1000 + s_suppkey % 50, '.') AS raw
FROM supplier""",
    "profile_pages": """
SELECT s_suppkey AS page_id,
       concat(CASE s_suppkey % 3 WHEN 0 THEN 'https://www.dir-a.example/' WHEN 1 THEN 'https://dir-b.example/network/' ELSE 'https://other.example/' END, 'n', s_suppkey) AS url,
       concat('<html><head><title>T ', s_suppkey, '</title><meta property="og:title" content="OG ', s_suppkey, '"></head><body>',
              CASE s_suppkey % 4 WHEN 0 THEN '' ELSE concat('<h1> ', s_name, ' &amp; Co</h1>') END,
              '<table><tr><th>Commission Type</th><td>CPA ', s_nationkey, '</td></tr><tr><th>Minimum  Payout</th><td>$', s_nationkey * 10, '</td></tr>',
              '<tr><th>Affiliate Manager</th><td><span class="manager-name">Manager ', s_suppkey % 5, '</span><a data-email="m', s_suppkey % 5,
              '@x', s_suppkey % 3, '.example.com" href="https://t.me/manager_', s_suppkey % 5, '">contact</a></td></tr></table>',
              '<dl><dt>Referral</dt><dd>', s_nationkey, '%</dd></dl>',
              CASE s_suppkey % 6 WHEN 0 THEN concat('<ul><li>Account Manager: Desk <a href="mailto:desk', s_suppkey % 4, '@x.example.com">m</a></li></ul>') ELSE '' END,
              '</body></html>') AS html
FROM supplier""",
    # directory pages as old hands wrote them: rows without tr, content between cells, tables in cells, elements left open
    "old_pages": """
SELECT 10000000 + s_suppkey AS page_id,
       concat(CASE CAST(floor(s_suppkey / 6) AS BIGINT) % 2 WHEN 0 THEN 'https://www.dir-a.example/' ELSE 'https://dir-b.example/network/' END, 'o', s_suppkey) AS url,
       concat('<title>Old ', s_suppkey, '</title>', CASE s_suppkey % 6
         WHEN 0 THEN concat('<table><td>Minimum payout<td>$', s_suppkey, '</table><table><th>Payment Frequency<td>Net ', s_nationkey, '<tr><td>odd</table>')
         WHEN 1 THEN concat('<div><table>Account Manager: <tr><td>Payment terms</td>stray ', s_suppkey, '<td>Weekly ', s_nationkey, '</td></tr></table></div></td>')
         WHEN 2 THEN concat('<div><div>Affiliate  Manager: <b>Joe ', s_nationkey, '</b></div><table><tr><td><table><td>Commission Type<td>CPS ', s_nationkey, '</table></td><td>x</td></tr></table></div>')
         WHEN 3 THEN concat('<ul><li>Network contact: <strong>Ann ', s_suppkey, '</strong> <a title="ann@x.example" href="skype:ann.', s_nationkey, '?chat">c</a><li>network  CONTACT <h3>ANN ', s_suppkey,
                            '</h3><i data-tippy="bob@x.example"></i></ul><dl><dt>Payout model<dd>RevShare ', s_nationkey, '<dt>Referral<dt>Minimum payout<dd>', s_suppkey, ' USD</dl>')
         WHEN 4 THEN concat('<ul><li>Account manager <b>Eve ', s_suppkey, '<li>Affiliate manager Zoe</ul>')
         ELSE concat('<table><tr><td>Referral rate<td>5%<tr><td>referral<td>', s_nationkey, '%<tr><td>Minimum payout<td> </table>') END) AS html
FROM supplier""",
    "directory_pages": """
SELECT page_id, url, html FROM profile_pages
UNION ALL SELECT page_id, url, html FROM old_pages""",
    "routes": """
SELECT host, min(layout) AS layout FROM (
  SELECT concat(CASE s_suppkey % 2 WHEN 0 THEN '' ELSE 'www.' END, CASE s_suppkey % 4 WHEN 0 THEN 'dir-a' WHEN 1 THEN 'dir-a' ELSE 'dir-b' END, '.example') AS host,
         CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A' ELSE 'B' END AS layout
  FROM supplier) AS r GROUP BY host""",
    "handle_snapshot": """
SELECT concat('handle_', c_custkey) AS handle,
       CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey * 1000 END AS user_id,
       c_custkey % 7 = 0 AS is_bot, c_custkey % 5 = 0 AS is_deleted, c_custkey % 3 = 0 AS was_verified,
       CASE c_custkey % 8 WHEN 3 THEN 'USERNAME_NOT_OCCUPIED' WHEN 7 THEN 'USERNAME_INVALID' ELSE '' END AS error_code
FROM customer""",
    "mx_snapshot": """
SELECT DISTINCT concat('mail', s_suppkey % 9, CASE s_suppkey % 5 WHEN 0 THEN '.example.ru' WHEN 1 THEN '.ukr.net' ELSE '.example.com' END) AS domain,
       CASE s_suppkey % 9 WHEN 4 THEN 0 ELSE 1 + s_suppkey % 9 END AS n_mx,
       CASE s_suppkey % 9 WHEN 4 THEN 'error' WHEN 5 THEN 'timeout' ELSE 'ok' END AS outcome
FROM supplier""",
    "lead_writes": """
SELECT o_orderkey AS seq, concat('https://lead.example/', o_custkey % 500) AS source_url, concat('id-', o_orderkey) AS id,
       CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('Company ', o_orderkey) END AS company_name,
       CASE o_orderkey % 4 WHEN 1 THEN concat('u', o_orderkey, '@example.com') ELSE '' END AS emails,
       CASE o_orderkey % 7 WHEN 2 THEN concat('h_', o_orderkey) ELSE '' END AS telegram_handles,
       CASE o_orderkey % 9 WHEN 4 THEN concat('@h_', o_orderkey, ':[VALID]') ELSE '' END AS tg_validation_status,
       CASE o_orderkey % 11 WHEN 3 THEN concat('skype:s', o_orderkey) ELSE '' END AS skype,
       CASE o_orderkey % 8 WHEN 5 THEN concat('linkedin.com/in/p', o_orderkey) ELSE '' END AS linkedin,
       CASE o_orderkey % 13 WHEN 6 THEN concat('tw', o_orderkey) ELSE '' END AS twitter,
       o_orderkey % 2 = 0 AS is_cis, CASE o_orderkey % 2 WHEN 0 THEN concat('reason ', o_orderkey) ELSE '' END AS cis_reason,
       o_orderkey % 5 = 0 AS mx_valid, o_orderdate AS written_at
FROM orders""",
    "listing_links": """
SELECT p_partkey % 8 AS cat_ord, 1 + CAST(floor(p_partkey / 80) AS BIGINT) AS page_no, p_partkey AS pos,
       concat('https://dir.example/n', CAST(floor(p_partkey / 8) AS BIGINT) % (30 + 40 * (p_partkey % 8)),
              CASE WHEN floor(p_partkey / 80) >= 23 THEN '-late' ELSE '' END) AS link
FROM part""",
    "target_lines": """
SELECT page_id AS ord, CASE page_id % 6 WHEN 0 THEN concat('  ', upper(url), ' ') WHEN 1 THEN '' WHEN 2 THEN concat('# ', url) ELSE url END AS line FROM pages
UNION ALL SELECT page_id + 1000000 AS ord, url AS line FROM pages""",
    # documents and turns of conversations, with the contact notes
    "texts": """
SELECT 'document' AS src, doc_id AS id, text AS raw FROM documents
UNION ALL SELECT 'turn' AS src, conv_id * 1000 + turn AS id, text AS raw FROM conversations
UNION ALL SELECT 'note' AS src, note_id AS id, raw FROM contact_notes""",
    # captured pages and profile pages with a layout each
    "laid_out": """
SELECT 'page' AS src, page_id, CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'default' END AS layout, html FROM pages
UNION ALL SELECT 'profile' AS src, page_id, CASE page_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'default' END AS layout, html FROM profile_pages""",
    "raw_handles": """
SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN concat('@Handle_', c_custkey % 60) WHEN 1 THEN concat('https://www.t.me/Handle_', c_custkey % 60, '?start=1')
       WHEN 2 THEN concat('HTTP://Telegram.me/handle_', c_custkey % 60, '/path') WHEN 3 THEN concat('  telegram.dog/@handle_', c_custkey % 60, ' tail ')
       WHEN 4 THEN c_name WHEN 5 THEN '  ' WHEN 6 THEN concat('handle_', c_custkey) ELSE concat('t.me/telegram.me/handle_', c_custkey % 60) END AS handle
FROM customer""",
    "raw_mails": """
SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN concat('User@Mail', c_custkey % 9, '.Example.RU') WHEN 1 THEN concat(' x@y@z', c_custkey, ' ') WHEN 2 THEN 'no-at'
       WHEN 3 THEN concat('@lead', c_custkey, '.example') WHEN 4 THEN 'tail@' WHEN 5 THEN concat('anna.sales@gmail.run', c_custkey) ELSE concat('info@mail', c_custkey % 9, '.example.com') END AS email
FROM customer""",
    "raw_times": """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN substr(CAST(o_orderdate AS VARCHAR(40)), 1, 19) WHEN 1 THEN concat(replace(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 19), ' ', 'T'), 'Z')
       WHEN 2 THEN concat(replace(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 19), ' ', 'T'), '.5+02:00') WHEN 3 THEN 'not a time'
       WHEN 4 THEN concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 5), '13-01 00:00:00') ELSE concat(substr(CAST(o_orderdate AS VARCHAR(40)), 1, 19), '.25') END AS raw
FROM orders""",
    "raw_statuses": """
SELECT c_custkey AS id, concat('@a', c_custkey, ':[VALID], bad', c_custkey, ', , @@b:[X]], c', c_custkey % 5, ':[NOT_FOUND]',
       CASE c_custkey % 3 WHEN 0 THEN ', @d:[' WHEN 1 THEN ',e:[INVALID]:[Z]' ELSE '' END) AS raw
FROM customer""",
    "href_cases": """
SELECT p_partkey AS id, 'https://Dir.example:8080/network/list?page=2#top' AS base,
       CASE p_partkey % 20 WHEN 0 THEN concat('/n', p_partkey) WHEN 1 THEN concat('n', p_partkey, '?ref=a#b') WHEN 2 THEN concat('https://dir.EXAMPLE/n', p_partkey, '/')
         WHEN 3 THEN concat('//dir.example/network/n', p_partkey) WHEN 4 THEN concat('https://other.example/n', p_partkey) WHEN 5 THEN '#top' WHEN 6 THEN 'JavaScript:go()'
         WHEN 7 THEN 'mailto:a@b.example' WHEN 8 THEN '' WHEN 9 THEN '/Login' WHEN 10 THEN concat('/page-', p_partkey) WHEN 11 THEN concat('/network/n', p_partkey, '/more?x=1')
         WHEN 12 THEN '/affpaying-offers' WHEN 13 THEN concat('../n', p_partkey) WHEN 14 THEN concat('/a/', p_partkey) WHEN 15 THEN '/network/' WHEN 16 THEN concat('  /N', p_partkey, '/  ')
         WHEN 17 THEN concat('/Network/N', p_partkey) WHEN 18 THEN concat('/x/../n', p_partkey) ELSE '?page=3' END AS href
FROM part""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = _sources(name)
    text = DERIVED[name]
    for source in sources:
        text = re.sub(rf"\bFROM {source}\b", f"FROM {{{source}}}", text)
    return spark.sql(text, **{source: derived(spark, sf_dir, source) for source in sources})


def _sources(name: str) -> list[str]:
    found = re.findall(r"\bFROM (\w+)", DERIVED[name])
    return [t for t in dict.fromkeys(found) if t in TABLES or t in DERIVED]


def ctes(*names: str) -> str:
    """``WITH`` clause with the derived tables, those they need first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in ordered:
            for source in _sources(name):
                visit(source)
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in ordered)
