"""Queries over text, URL and rule columns, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import oracle_parts as o
from catalog.derived import ctes, derived
from leadweave import fixed
from leadweave.functions import rules, text, urls
from leadweave.functions.lists import ordered_unique
from leadweave.operators.discover import hrefs, page_links
from leadweave.operators.lookups import error_verdict
from leadweave.plans.leads import with_layout
from leadweave.session import spread
from leadweave.sources.lists import clean_lines, list_items, target_list

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(derived(spark, sf, "texts"))


# --- sources ----------------------------------------------------------------

@query("q_line_source", ctes("target_lines") + f" SELECT ord, {o.trim('line')} AS line FROM target_lines WHERE {o.trim('line')} <> '' AND NOT starts_with({o.trim('line')}, '#')")
def q_line_source(spark, sf):
    return clean_lines(derived(spark, sf, "target_lines"))


@query("q_list_source", f"SELECT doc_id, pos, {o.trim('value')} AS value FROM (SELECT doc_id, unnest(string_split(text, ',')) AS value, "
       f"generate_subscripts(string_split(text, ','), 1) - 1 AS pos FROM documents) WHERE {o.trim('value')} <> ''")
def q_list_source(spark, sf):
    return list_items(spread(derived(spark, sf, "documents")), "text", ["doc_id"])


@query("q_target_union", ctes("target_lines") + f""" SELECT 0 AS source, doc_id AS ord, pos, {o.trim('value')} AS value FROM (SELECT doc_id, unnest(string_split(concat(source, ', ,', lang, ', ', n_chars), ',')) AS value,
 generate_subscripts(string_split(concat(source, ', ,', lang, ', ', n_chars), ','), 1) - 1 AS pos FROM documents) WHERE {o.trim('value')} <> ''
 UNION ALL SELECT 1 AS source, ord, 0 AS pos, {o.trim('line')} AS value FROM target_lines WHERE {o.trim('line')} <> '' AND NOT starts_with({o.trim('line')}, '#')""")
def q_target_union(spark, sf):
    listed = derived(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat("source", F.lit(", ,"), "lang", F.lit(", "), "n_chars").alias("v"))
    return target_list(list_items(listed, "v", ["ord"]), clean_lines(derived(spark, sf, "target_lines")))


@query("q_page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def q_page_scan(spark, sf):
    return derived(spark, sf, "pages").select("page_id", "url", F.length("html").alias("n_chars"))


# --- contact columns ---------------------------------------------------------

def _register_kind(name: str, kind: str, column) -> None:
    @query(name, ctes("texts") + f" SELECT * FROM ({o.contacts(kind, 'texts', 'src, id')})")
    def run(spark, sf):
        return _texts(spark, sf).select("src", "id", F.posexplode(column("raw")).alias("pos", "value"))


_register_kind("q_emails", "emails", text.emails)
_register_kind("q_telegram_handles", "telegram", text.telegram_handles)
_register_kind("q_twitter_handles", "twitter", text.twitter_handles)
_register_kind("q_linkedin_links", "linkedin", text.linkedin_links)
_register_kind("q_skype_ids", "skype", text.skype_ids)
_register_kind("q_discord", "discord", text.discord_names)


def _long(rows: DataFrame, keys: list[str]) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"contacts.{k}").alias("vals")) for k in text.CONTACT_KINDS])
    return rows.select(*keys, F.inline(kinds)).select(*keys, "kind", F.posexplode("vals").alias("pos", "value"))


@query("q_contacts_long", ctes("texts") + " " + o.contacts_long("texts", "src, id"))
def q_contacts_long(spark, sf):
    return _long(_texts(spark, sf).select("src", "id", text.extract_contacts("raw").alias("contacts")), ["src", "id"])


@query("q_contact_counts", ctes("texts") + f" SELECT src, kind, count(*) AS n_values, count(DISTINCT id) AS n_texts, count(DISTINCT value) AS n_distinct FROM ({o.contacts_long('texts', 'src, id')}) GROUP BY src, kind")
def q_contact_counts(spark, sf):
    return q_contacts_long(spark, sf).groupBy("src", "kind").agg(
        F.count("*").alias("n_values"), F.countDistinct("id").alias("n_texts"), F.countDistinct("value").alias("n_distinct"))


@query("q_clean_token", ctes("texts") + f" SELECT token, count(*) AS n FROM (SELECT {o.clean('w')} AS token FROM (SELECT unnest(string_split(raw, ' ')) AS w FROM texts)) GROUP BY token")
def q_clean_token(spark, sf):
    words = _texts(spark, sf).select(F.explode(F.split("raw", " ")).alias("w"))
    return words.groupBy("w").count().select(text.clean_token("w").alias("token"), "count").groupBy("token").agg(F.sum("count").alias("n"))


@query("q_ordered_unique", f"SELECT doc_id, count(*) AS n, md5(string_agg(value, '|' ORDER BY pos)) AS digest FROM ({o.unique('SELECT doc_id, unnest(string_split(text, chr(32))) AS v, generate_subscripts(string_split(text, chr(32)), 1) AS i FROM documents', 'doc_id')}) GROUP BY doc_id")
def q_ordered_unique(spark, sf):
    # the list is worked out once per row and handed to both results; a filter on it would be pushed down and repeat the work
    rows = F.transform(F.array(ordered_unique(F.split("text", " "))), lambda u: F.struct(F.size(u).cast("bigint").alias("n"), F.md5(F.array_join(u, "|").cast("binary")).alias("digest")))
    return spread(derived(spark, sf, "documents")).select("doc_id", F.inline(F.filter(rows, lambda r: r["n"] > 0)))


@query("q_asset_suffix", ctes("texts") + f" SELECT src, id, i - 1 AS pos, lower({o.clean('m')}) AS value, {o.any_suffix('lower(' + o.clean('m') + ')')} AS is_asset FROM ({o._matches(o.EMAIL, 1, 'texts', 'src, id')})")
def q_asset_suffix(spark, sf):
    found = F.when(F.contains("raw", F.lit("@")), F.regexp_extract_all("raw", F.lit(fixed.EMAIL), F.lit(1)))
    rows = _texts(spark, sf).select("src", "id", F.posexplode(found).alias("pos", "m")).withColumn("value", F.lower(text.clean_token("m")))
    return rows.select("src", "id", "pos", "value", text.has_asset_suffix("value").alias("is_asset"))


@query("q_noise_flag", "SELECT page_id, contains(lower(url), 'spam-farm') OR contains(lower(url), 'blog.') AS is_noise FROM pages")
def q_noise_flag(spark, sf):
    return derived(spark, sf, "pages").select("page_id", text.is_noise("url", terms=("spam-farm", "blog.")).alias("is_noise"))


@query("q_normalize_handle", ctes("raw_handles") + f" SELECT id, {o.normalize_handle('handle')} AS handle FROM raw_handles")
def q_normalize_handle(spark, sf):
    return derived(spark, sf, "raw_handles").select("id", text.normalize_handle("handle").alias("handle"))


@query("q_mail_domain", ctes("raw_mails") + rf" SELECT id, lower(regexp_extract({o.trim('email')}, '(?s)^[^@]*@(.+)\z', 1)) AS domain FROM raw_mails")
def q_mail_domain(spark, sf):
    return derived(spark, sf, "raw_mails").select("id", text.mail_domain("email").alias("domain"))


_PARTS = f"list_filter(list_transform(string_split(text, ','), lambda x: {o.trim('x')}), lambda x: x <> '')"


@query("q_list_roundtrip", f"SELECT doc_id, CASE WHEN {o.trim('text')} <> '' THEN len({_PARTS}) END AS n, md5(array_to_string({_PARTS}, ',')) AS digest FROM documents WHERE {o.trim('text')} <> ''")
def q_list_roundtrip(spark, sf):
    rows = F.transform(F.array(text.split_list("text")), lambda p: F.struct(F.size(p).cast("bigint").alias("n"), F.md5(text.join_list(p).cast("binary")).alias("digest")))
    return spread(derived(spark, sf, "documents")).select("doc_id", F.inline(F.filter(rows, lambda r: r["digest"].isNotNull())))


@query("q_status_parse", ctes("raw_statuses") + rf""" , items AS (SELECT id, i, {o.trim('item')} AS item FROM (SELECT id, unnest(string_split(raw, ',')) AS item, generate_subscripts(string_split(raw, ','), 1) AS i FROM raw_statuses)),
 bare AS (SELECT id, i, CASE WHEN starts_with(item, '@') THEN substr(item, 2) ELSE item END AS item FROM items WHERE contains(item, ':['))
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, substr(item, 1, instr(item, ':[') - 1) AS username,
 regexp_replace(substr(item, instr(item, ':[') + 2), '\]\z', '') AS status FROM bare""")
def q_status_parse(spark, sf):
    rows = derived(spark, sf, "raw_statuses").select("id", F.posexplode(text.parse_statuses("raw")).alias("pos", "r"))
    return rows.select("id", "pos", "r.username", "r.status")


@query("q_parse_time", ctes("raw_times") + """ SELECT id, strftime(CASE WHEN regexp_matches(raw, '^\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d(\\.\\d+)?$') THEN try_cast(raw AS TIMESTAMP)
 WHEN ends_with(raw, 'Z') THEN try_cast(replace(rtrim(raw, 'Z'), 'T', ' ') AS TIMESTAMP)
 WHEN ends_with(raw, '+02:00') THEN try_cast(replace(replace(raw, '+02:00', ''), 'T', ' ') AS TIMESTAMP) - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S.%g') AS parsed FROM raw_times""")
def q_parse_time(spark, sf):
    return derived(spark, sf, "raw_times").select("id", text.utc_text(text.parse_time("raw"), "yyyy-MM-dd HH:mm:ss.SSS").alias("parsed"))


# --- URLs ---------------------------------------------------------------------

@query("q_lead_id", "SELECT page_id, sha256(url) AS id FROM pages")
def q_lead_id(spark, sf):
    return derived(spark, sf, "pages").select("page_id", urls.lead_id("url").alias("id"))


@query("q_source_domain", ctes("target_lines") + f" SELECT ord, {o.host('line')} AS domain FROM target_lines")
def q_source_domain(spark, sf):
    return derived(spark, sf, "target_lines").select("ord", urls.source_domain("line").alias("domain"))


_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_FIELDS = (f"list_filter(list_transform(list_filter(string_split({_QUERY}, '&'), lambda v: v <> ''), lambda v: CASE WHEN contains(v, '=') THEN v ELSE v || '=' END), "
           f"lambda v: NOT starts_with(v, 'page='))")


@query("q_page_url", f"SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_sort(list_append({_FIELDS}, 'page=' || (1 + page_id % 7))), '&') AS page_url FROM pages")
def q_page_url(spark, sf):
    return derived(spark, sf, "pages").select("page_id", urls.page_url("url", 1 + F.col("page_id") % 7).alias("page_url"))


def _oracle_escape(path: str) -> str:
    escaped = f"replace(url_encode({path}), '%2F', '/')"
    for code, plain in (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@")):
        escaped = f"replace({escaped}, '{code}', '{plain}')"
    return f"CASE WHEN regexp_matches({path}, '^[A-Za-z0-9_.~$&+,/:;=@!''()*-]*$') THEN {path} ELSE {escaped} END"


_SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)"""
_HREF_ROWS = f"SELECT page_id, url, generate_subscripts(regexp_extract_all(html, '{_HREF}', 1), 1) - 1 AS pos, {o.trim('unnest(regexp_extract_all(html, ' + chr(39) + _HREF + chr(39) + ', 1))')} AS href FROM pages"
_PAGE_CARD = f"""CASE WHEN regexp_matches(href, '^/[^/?#]+/?$') AND lower(trim(href, '/')) NOT IN {o.values(fixed.CARD_PATH_BLACKLIST)}
 AND NOT starts_with(lower(trim(href, '/')), 'page-') AND NOT {o.noise('href')} THEN {_SITE} || {_oracle_escape('href')} END"""


@query("q_card_links", f"SELECT page_id, pos, href, {_PAGE_CARD} AS link FROM ({_HREF_ROWS})")
def q_card_links(spark, sf):
    rows = spread(derived(spark, sf, "pages")).select("page_id", "url", F.posexplode(hrefs("html")).alias("pos", "href"))
    return rows.select("page_id", "pos", "href", urls.card_link("href", "url").alias("link"))


@query("q_page_links", f"SELECT page_id, pos, value AS link FROM ({o.unique(f'SELECT page_id, pos AS i, {_PAGE_CARD} AS v FROM ({_HREF_ROWS})', 'page_id')})")
def q_page_links(spark, sf):
    return page_links(spread(derived(spark, sf, "pages"))).select("page_id", "pos", "link")


# the base of href_cases is one listing page, so the expected link follows from the case number
_CASE_KIND = "p.id % 20"
_CASE_LINK = """CASE k WHEN 0 THEN 'https://Dir.example:8080/n' || id WHEN 1 THEN 'https://Dir.example:8080/network/n' || id WHEN 2 THEN 'https://dir.EXAMPLE/n' || id || '/'
 WHEN 3 THEN 'https://dir.example/network/n' || id WHEN 11 THEN 'https://Dir.example:8080/network/n' || id || '/more' WHEN 13 THEN 'https://Dir.example:8080/n' || id
 WHEN 16 THEN 'https://Dir.example:8080/N' || id || '/' WHEN 17 THEN 'https://Dir.example:8080/Network/N' || id WHEN 18 THEN 'https://Dir.example:8080/n' || id
 WHEN 15 THEN 'https://Dir.example:8080/network/' WHEN 19 THEN 'https://Dir.example:8080/network/list' END"""


@query("q_profile_links", ctes("href_cases") + f""" SELECT id, href, CASE WHEN k IN (0, 2, 13, 15, 16, 18) THEN {_CASE_LINK} END AS card,
 CASE WHEN k IN (1, 3, 11, 17, 19) THEN {_CASE_LINK} END AS profile FROM (SELECT id, href, id % 20 AS k FROM href_cases)""")
def q_profile_links(spark, sf):
    return derived(spark, sf, "href_cases").select("id", "href", urls.card_link("href", "base").alias("card"), urls.profile_link("href", "base").alias("profile"))


@query("q_url_rejects", ctes("target_lines") + f" SELECT ord, 'target URL \"' || line || '\" must include a scheme and host' AS reason FROM target_lines WHERE {o.route_host('line')} = ''")
def q_url_rejects(spark, sf):
    return derived(spark, sf, "target_lines").select("ord", urls.url_problem("line").alias("reason")).filter(F.col("reason").isNotNull())


@query("q_layout_route", ctes("profile_pages", "routes") + f" SELECT p.page_id, p.url, coalesce(r.layout, 'default') AS layout FROM profile_pages p LEFT JOIN routes r ON r.host = {o.route_host('p.url')}")
def q_layout_route(spark, sf):
    return with_layout(derived(spark, sf, "profile_pages"), derived(spark, sf, "routes")).select("page_id", "url", "layout")


@query("q_error_verdict", ctes("handle_snapshot") + f""" SELECT handle, CASE WHEN contains(error_code, 'USERNAME_NOT_OCCUPIED') THEN 'NOT_FOUND' ELSE 'INVALID' END AS status,
 CASE WHEN contains(error_code, 'USERNAME_NOT_OCCUPIED') THEN '{fixed.NOT_OCCUPIED_TEXT}' ELSE error_code END AS error_reason FROM handle_snapshot WHERE error_code <> ''""")
def q_error_verdict(spark, sf):
    status, reason = error_verdict("error_code")
    return derived(spark, sf, "handle_snapshot").filter("error_code <> ''").select("handle", status.alias("status"), reason.alias("error_reason"))


# --- rules --------------------------------------------------------------------

@query("q_rule_name", ctes("contact_notes") + f""", names AS (SELECT 'note' AS src, note_id AS id, raw_name AS name FROM contact_notes UNION ALL SELECT 'part' AS src, p_partkey AS id, p_name AS name FROM part)
 SELECT src, id, name, {o.name_reason('name')} AS reason FROM names""")
def q_rule_name(spark, sf):
    names = derived(spark, sf, "contact_notes").select(F.lit("note").alias("src"), F.col("note_id").alias("id"), F.col("raw_name").alias("name"))
    parts = derived(spark, sf, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return names.unionAll(parts).select("src", "id", "name", rules.name_reason("name", rules.NameRules()).alias("reason"))


@query("q_rule_mail", ctes("texts", "raw_mails") + f""", mails AS (SELECT src, id, pos, value AS email FROM ({o.contacts('emails', 'texts', 'src, id')}) UNION ALL SELECT 'customer' AS src, id, 0 AS pos, email FROM raw_mails)
 SELECT src, id, pos, email, {o.mail_reason('email', False)} AS reason, {o.mail_reason('email', True)} AS reason_with_names FROM mails""")
def q_rule_mail(spark, sf):
    found = _texts(spark, sf).select("src", "id", F.posexplode(text.emails("raw")).alias("pos", "email"))
    mails = found.unionAll(derived(spark, sf, "raw_mails").select(F.lit("customer").alias("src"), "id", F.lit(0).alias("pos"), "email"))
    return mails.select("*", rules.mail_reason("email", rules.MailRules()).alias("reason"),
                        rules.mail_reason("email", rules.MailRules(), rules.NameRules()).alias("reason_with_names"))


_EMAILS, _HANDLES = o.contacts("emails", "contact_notes", "note_id"), o.contacts("telegram", "contact_notes", "note_id")


@query("q_rule_classify", ctes("contact_notes") + f""", mail AS (SELECT note_id, arg_min(reason, pos) AS reason FROM (SELECT note_id, pos, {o.mail_reason('value', True)} AS reason FROM ({_EMAILS})) WHERE reason IS NOT NULL GROUP BY note_id),
 handle AS (SELECT note_id, arg_min(reason, pos) AS reason FROM (SELECT note_id, pos, 'Telegram handle match: ' || {o.name_reason('value')} AS reason FROM ({_HANDLES})) WHERE reason IS NOT NULL GROUP BY note_id),
 found AS (SELECT n.note_id, coalesce('Name match: ' || {o.name_reason('n.raw_name')}, m.reason, h.reason, '') AS cis_reason FROM contact_notes n LEFT JOIN mail m USING (note_id) LEFT JOIN handle h USING (note_id))
 SELECT note_id, cis_reason <> '' AS is_cis, cis_reason FROM found""")
def q_rule_classify(spark, sf):
    notes = derived(spark, sf, "contact_notes").select("note_id", "raw_name", F.col("raw_name").alias("company_name"), text.extract_contacts("raw").alias("contacts"))
    return rules.classify(notes, rules.MailRules(), rules.NameRules()).select("note_id", "is_cis", "cis_reason")
