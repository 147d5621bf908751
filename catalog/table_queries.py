"""Queries over lookups, dedup, the store, exports, reports and streams, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog import oracle_parts as o
from catalog.derived import ctes, derived
from catalog.text_queries import query
from leadweave import fixed
from leadweave.functions.rules import MailRules, classify
from leadweave.functions.text import as_utc, emails, extract_contacts, mail_domain, status_class, status_text, utc_text
from leadweave.functions.urls import lead_id, source_domain
from leadweave.operators.dedup import first_seen, shared_keys
from leadweave.operators.discover import discover, pagination_stop, without_known
from leadweave.operators.lookup_cache import ask_domains, cached_lookup, result_table
from leadweave.operators.lookups import check_domains, handle_results, lead_mx, verify_domains, verify_handles
from leadweave.operators.summary import column_widths, handle_report, run_summary, verdict_counts
from leadweave.session import scratch_dir, spread, write_once
from leadweave.sources.export import CSV_OPTIONS, flatten_leads, flatten_stored, nested_leads, write_leads
from leadweave.sources.store import append_writes, compact, fold_state, folded, known_urls, lead_table, merge_states, publish, publish_ordered, read_published, read_writes, scan_leads, scan_page, upsert_fold
from leadweave.sources.versioned import VersionedTable
from leadweave.streaming import jobs

# --- dedup and discovery -------------------------------------------------------

_NORM = f"lower({o.trim('line')})"


@query("q_first_seen", ctes("target_lines") + f" SELECT ord, line FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY ord) AS rn FROM target_lines WHERE {_NORM} <> '') WHERE rn = 1")
def q_first_seen(spark, sf):
    return first_seen(derived(spark, sf, "target_lines"), "line", ["ord"])


_FRESH = "fresh AS (SELECT DISTINCT cat_ord, page_no FROM (SELECT cat_ord, link, min(page_no) AS page_no FROM listing_links GROUP BY cat_ord, link))"
_STOP = "stops AS (SELECT cat_ord, max(page_no) AS last_page FROM (SELECT *, row_number() OVER (PARTITION BY cat_ord ORDER BY page_no) AS rn FROM fresh) WHERE rn = page_no GROUP BY cat_ord)"
_FOUND = "found AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY link ORDER BY l.cat_ord, page_no, pos) AS rn FROM listing_links l JOIN stops USING (cat_ord) WHERE page_no <= last_page) WHERE rn = 1)"
_DISCOVER = ctes("listing_links") + f", {_FRESH}, {_STOP}, {_FOUND} "


@query("q_pagination_stop", ctes("listing_links") + f", {_FRESH}, {_STOP} SELECT cat_ord, last_page FROM stops")
def q_pagination_stop(spark, sf):
    return pagination_stop(derived(spark, sf, "listing_links"))


@query("q_discover_cards", _DISCOVER + "SELECT cat_ord, page_no, pos, link FROM found")
def q_discover_cards(spark, sf):
    return discover(derived(spark, sf, "listing_links"))


_KNOWN = "SELECT concat('https://dir.example/n', p_partkey) AS source_url FROM part WHERE p_size > 25"


@query("q_known_url_anti", _DISCOVER + f"SELECT cat_ord, page_no, pos, link FROM found WHERE link NOT IN ({_KNOWN})")
def q_known_url_anti(spark, sf):
    known = derived(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("https://dir.example/n"), "p_partkey").alias("source_url"))
    return without_known(discover(derived(spark, sf, "listing_links")), known).select("cat_ord", "page_no", "pos", "link")


@query("q_shared_emails", ctes("texts") + f" SELECT value AS email, count(*) AS n_leads FROM (SELECT DISTINCT value, src, id FROM ({o.contacts('emails', 'texts', 'src, id')})) GROUP BY value")
def q_shared_emails(spark, sf):
    rows = spread(derived(spark, sf, "texts")).select("src", "id", F.explode(emails("raw")).alias("email"))
    return shared_keys(rows, "email", F.struct("src", "id")).select(F.col("key").alias("email"), F.col("n_owners").alias("n_leads"))


# --- lookups ---------------------------------------------------------------------

def _notes(spark, sf) -> DataFrame:
    notes = derived(spark, sf, "contact_notes").select("note_id", "raw_name", "raw")
    return notes.select(
        lead_id(F.concat(F.lit("https://note.example/"), "note_id")).alias("id"), "note_id", F.concat(F.lit("https://note.example/"), "note_id").alias("source_url"),
        "raw_name", F.col("raw_name").alias("company_name"), extract_contacts("raw").alias("contacts"))


def _checked_notes(spark, sf) -> DataFrame:
    return verify_handles(write_once(_notes(spark, sf), "notes"), derived(spark, sf, "handle_snapshot"), "note_id")


_HANDLES = o.contacts("telegram", "contact_notes", "note_id")
_RESULTS = ctes("contact_notes", "handle_snapshot", "mx_snapshot") + f", results AS (SELECT h.note_id, h.pos, h.value AS username, {o.select_verdict('h.value')} FROM ({_HANDLES}) h LEFT JOIN handle_snapshot s ON s.handle = h.value) "
_FIELDS = "username, status, user_id, is_bot, is_deleted, was_verified, error_reason"


@query("q_handle_verdict", _RESULTS + f"SELECT note_id, pos, {_FIELDS} FROM results")
def q_handle_verdict(spark, sf):
    rows = handle_results(_notes(spark, sf), derived(spark, sf, "handle_snapshot"), "note_id").select("note_id", F.posexplode("tg_results").alias("pos", "r"))
    return rows.select("note_id", "pos", *[F.col("r").getField(f).alias(f) for f in _FIELDS.split(", ")])


@query("q_usable_handles", _RESULTS + "SELECT note_id, count(*) AS n_results, coalesce(string_agg(username, ',' ORDER BY pos) FILTER (status IN ('VALID', 'SKIPPED')), '') AS usable FROM results GROUP BY note_id")
def q_usable_handles(spark, sf):
    return _checked_notes(spark, sf).select("note_id", F.size("tg_results").cast("bigint").alias("n_results"), F.array_join("contacts.telegram", ",").alias("usable"))


@query("q_verdict_counts", _RESULTS + """SELECT count(*) AS extracted, count(*) AS checked, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'NOT_FOUND') AS not_found,
 count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'DELETED') AS deleted FROM results""")
def q_verdict_counts(spark, sf):
    return verdict_counts(_checked_notes(spark, sf))


_STATUS = "string_agg('@' || username || ':[' || status || ']', ', ' ORDER BY pos)"


@query("q_status_text", _RESULTS + f"SELECT n.note_id, coalesce({_STATUS}, '') AS stored, coalesce({_STATUS}, 'N/A') AS exported FROM contact_notes n LEFT JOIN results USING (note_id) GROUP BY n.note_id")
def q_status_text(spark, sf):
    return _checked_notes(spark, sf).select("note_id", status_text("tg_results").alias("stored"), status_text("tg_results", "N/A").alias("exported"))


@query("q_status_class", _RESULTS + "SELECT n.note_id, CASE WHEN r.status = 'VALID' THEN 'valid' WHEN r.status IS NOT NULL THEN 'invalid' END AS status_class FROM contact_notes n LEFT JOIN results r ON r.note_id = n.note_id AND r.pos = 0")
def q_status_class(spark, sf):
    return _checked_notes(spark, sf).select("note_id", status_class("tg_results").alias("status_class"))


@query("q_handle_report", ctes("raw_handles", "handle_snapshot") + f""", rows AS (SELECT id, {o.normalize_handle('handle')} AS username FROM raw_handles)
 SELECT id, username, {o.select_verdict('username')} FROM rows LEFT JOIN handle_snapshot s ON s.handle = username""".replace(f", {o.verdict('username')['error_reason']} AS error_reason", ""))
def q_handle_report(spark, sf):
    return handle_report(derived(spark, sf, "raw_handles"), derived(spark, sf, "handle_snapshot"), "handle", ["id"])


_OK = "(m.outcome = 'timeout' OR m.n_mx > 0)"


@query("q_mx_lookup", ctes("raw_mails", "mx_snapshot") + rf""", rows AS (SELECT id, email, lower(regexp_extract({o.trim('email')}, '(?s)^[^@]*@(.+)\z', 1)) AS domain FROM raw_mails)
 SELECT id, r.domain, coalesce({_OK}, false) AND r.domain <> '' AS mx_ok FROM rows r LEFT JOIN mx_snapshot m ON m.domain = r.domain""")
def q_mx_lookup(spark, sf):
    return check_domains(derived(spark, sf, "raw_mails"), derived(spark, sf, "mx_snapshot"), "email").select("id", "domain", "mx_ok")


_MAILS = o.contacts("emails", "contact_notes", "note_id")
_LEAD_MX = f"SELECT e.note_id, bool_or(coalesce({_OK}, false)) AS mx_valid FROM ({_MAILS}) e LEFT JOIN mx_snapshot m ON m.domain = split_part(e.value, '@', 2) GROUP BY e.note_id"


@query("q_lead_mx", ctes("contact_notes", "mx_snapshot") + " " + _LEAD_MX)
def q_lead_mx(spark, sf):
    return lead_mx(_notes(spark, sf), derived(spark, sf, "mx_snapshot"), "note_id")


# --- whole leads: exports and summary ----------------------------------------------

_CREATED = "2024-05-06 07:08:09"


def _leads(spark, sf) -> DataFrame:
    """Contact notes as fully processed leads."""
    flagged = write_once(classify(_notes(spark, sf), MailRules(), None), "notes")
    checked = verify_handles(flagged, derived(spark, sf, "handle_snapshot"), "note_id")
    leads = verify_domains(checked, derived(spark, sf, "mx_snapshot"), "note_id")
    return leads.withColumn("created_at", as_utc(F.lit(_CREATED)))


def _joined(kind: str) -> str:
    return f"SELECT note_id, string_agg(value, ', ' ORDER BY pos) AS v FROM ({o.contacts(kind, 'contact_notes', 'note_id')}) GROUP BY note_id"


_REASONS = f"SELECT note_id, arg_min(reason, pos) AS reason FROM (SELECT note_id, pos, {o.mail_reason('value', False)} AS reason FROM ({_MAILS})) WHERE reason IS NOT NULL GROUP BY note_id"
_FLAT_CTES = _RESULTS + f""", c_emails AS ({_joined('emails')}), c_linkedin AS ({_joined('linkedin')}), c_skype AS ({_joined('skype')}), c_discord AS ({_joined('discord')}), c_twitter AS ({_joined('twitter')}),
 c_status AS (SELECT note_id, {_STATUS} AS statuses, string_agg(username, ', ' ORDER BY pos) FILTER (status IN ('VALID', 'SKIPPED')) AS usable FROM results GROUP BY note_id), reasons AS ({_REASONS}), mx AS ({_LEAD_MX}),
 flat AS (SELECT sha256('https://note.example/' || n.note_id) AS "ID", raw_name AS "Company Name", 'https://note.example/' || n.note_id AS "Source URL", coalesce(c_emails.v, '') AS "Emails", coalesce(usable, '') AS "Telegram Handles",
 coalesce(statuses, 'N/A') AS "TG Validation Status", coalesce(c_linkedin.v, '') AS "LinkedIn", coalesce(c_skype.v, '') AS "Skype", coalesce(c_discord.v, '') AS "Discord", coalesce(c_twitter.v, '') AS "Twitter",
 CASE WHEN reason IS NULL THEN 'false' ELSE 'true' END AS "Is CIS", coalesce(reason, '') AS "CIS Reason", '{_CREATED}' AS "Created At"
 FROM contact_notes n LEFT JOIN c_emails USING (note_id) LEFT JOIN c_linkedin USING (note_id) LEFT JOIN c_skype USING (note_id) LEFT JOIN c_discord USING (note_id) LEFT JOIN c_twitter USING (note_id) LEFT JOIN c_status USING (note_id) LEFT JOIN reasons USING (note_id)) """


@query("q_export_flat", _FLAT_CTES + "SELECT * FROM flat")
def q_export_flat(spark, sf):
    return flatten_leads(_leads(spark, sf))


@query("q_csv_roundtrip", _FLAT_CTES + "SELECT * FROM flat")
def q_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "export") + ".csv"
    write_leads(_leads(spark, sf), path)
    schema = ", ".join(f"`{t}` string" for t in fixed.EXPORT_TITLES)
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


@query("q_export_json", _FLAT_CTES + """SELECT sha256('https://note.example/' || n.note_id) AS id, raw_name, coalesce(c_emails.v, '') AS emails, coalesce(c_discord.v, '') AS discord, reason AS cis_reason,
 (SELECT count(*) FROM results r WHERE r.note_id = n.note_id) AS n_results, (SELECT count(*) FROM results r WHERE r.note_id = n.note_id AND user_id <> 0) AS n_user_ids, coalesce(mx_valid, false) AS mx_valid
 FROM contact_notes n LEFT JOIN c_emails USING (note_id) LEFT JOIN c_discord USING (note_id) LEFT JOIN reasons USING (note_id) LEFT JOIN mx USING (note_id)""")
def q_export_json(spark, sf):
    path = scratch_dir(spark, "export") + ".json"
    leads = _leads(spark, sf)
    write_leads(leads, path)
    back = spark.read.schema(nested_leads(leads).schema).json(path)
    with_id = F.filter("tg_results", lambda r: r["user_id"].isNotNull())
    return back.select("id", "raw_name", F.array_join("contacts.emails", ", ").alias("emails"), F.array_join("contacts.discord", ", ").alias("discord"), "cis_reason",
                       F.coalesce(F.size("tg_results"), F.lit(0)).cast("bigint").alias("n_results"), F.coalesce(F.size(with_id), F.lit(0)).cast("bigint").alias("n_user_ids"), "mx_valid")


_WIDTHS = " UNION ALL ".join(f"""SELECT {i} AS pos, '{t}' AS title, least(60, greatest(12, {len(t)}, max(length("{t}")))) + 2 AS width FROM flat""" for i, t in enumerate(fixed.EXPORT_TITLES))


@query("q_column_widths", _FLAT_CTES + _WIDTHS)
def q_column_widths(spark, sf):
    return column_widths(flatten_leads(_leads(spark, sf)))


@query("q_run_summary", _FLAT_CTES + """, counts AS (SELECT (SELECT count(*) FROM supplier) AS targets, count(*) AS leads, count(*) FILTER ("Is CIS" = 'true') AS flagged, count(*) FILTER ("Is CIS" = 'false') AS unflagged FROM flat),
 handles AS (SELECT count(*) AS handles_extracted, count(*) AS handles_checked, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'NOT_FOUND') AS not_found, count(*) FILTER (status = 'INVALID') AS invalid,
 count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'DELETED') AS deleted FROM results)
 SELECT counts.*, handles.*, round(flagged * 100.0 / (flagged + unflagged), 1)::DOUBLE AS flagged_pct, round(unflagged * 100.0 / (flagged + unflagged), 1)::DOUBLE AS unflagged_pct FROM counts, handles""")
def q_run_summary(spark, sf):
    return run_summary(derived(spark, sf, "supplier"), _leads(spark, sf))


# --- store ---------------------------------------------------------------------------

def _latest(c: str) -> str:
    return f"coalesce(arg_max({c}, seq) FILTER ({c} <> ''), '') AS {c}"


_FOLDED = f"""folded AS (SELECT source_url, arg_min(id, seq) AS id, {_latest('company_name')}, {_latest('emails')}, {_latest('telegram_handles')}, {_latest('tg_validation_status')}, {_latest('skype')}, {_latest('linkedin')}, {_latest('twitter')}, {_latest('cis_reason')},
 arg_max(is_cis, seq) AS is_cis, arg_max(mx_valid, seq) AS mx_valid, arg_min(written_at, seq) AS created_at, arg_max(written_at, seq) AS updated_at, max(seq) AS seq FROM lead_writes GROUP BY source_url)"""
_STORE = ctes("lead_writes") + f", {_FOLDED} "
_TIMES = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"
_COLUMNS = ("source_url", "id", "company_name", "emails", "telegram_handles", "tg_validation_status", "skype", "linkedin", "twitter", "cis_reason", "is_cis", "mx_valid")


def _writes(spark, sf) -> DataFrame:
    return derived(spark, sf, "lead_writes").withColumn("written_at", as_utc("written_at"))


def _shown(rows: DataFrame, columns=_COLUMNS) -> DataFrame:
    return rows.select(*columns, *[utc_text(c).alias(c) for c in ("created_at", "updated_at")])


def _published(spark, sf) -> DataFrame:
    """Write log in two batches, folded, published and read back."""
    log, table = scratch_dir(spark, "writes"), scratch_dir(spark, "leads")
    writes = _writes(spark, sf)
    append_writes(writes.filter("seq % 2 = 0"), log, "even", 0)
    append_writes(writes.filter("seq % 2 = 1"), log, "odd", 0)
    append_writes(writes.filter("seq % 2 = 1"), log, "odd", 0)
    folded = upsert_fold(read_writes(spark, log, writes.schema))
    stored = folded.withColumn("source_domain", source_domain("source_url"))
    publish(stored, table)
    return read_published(spark, table, stored.schema)


@query("q_lead_upsert", _STORE + f"SELECT {', '.join(_COLUMNS)}, {_TIMES} FROM folded")
def q_lead_upsert(spark, sf):
    return _shown(upsert_fold(_writes(spark, sf)))


@query("q_upsert_refold", _STORE + f"SELECT {', '.join(_COLUMNS)}, {_TIMES} FROM folded")
def q_upsert_refold(spark, sf):
    """A log compacted in the middle, compacted again, and newer writes folded onto it."""
    log, writes = scratch_dir(spark, "writes"), _writes(spark, sf)
    append_writes(writes.filter("seq % 3 = 0"), log, "a", 0)
    once = compact(spark, log, scratch_dir(spark, "state"), writes.schema)
    append_writes(writes.filter("seq % 3 = 1"), log, "b", 0)
    twice = compact(spark, log, scratch_dir(spark, "state"), writes.schema, once)
    return _shown(folded(merge_states(twice.unionByName(fold_state(writes.filter("seq % 3 = 2"))))))


@query("q_versioned_upsert", _STORE + f"SELECT {', '.join(_COLUMNS)}, {_TIMES} FROM folded")
def q_versioned_upsert(spark, sf):
    """Batches of two writers committed one after another, one of them twice; the last version read."""
    writes = _writes(spark, sf)
    table = lead_table(spark, scratch_dir(spark, "table"))
    for writer, batch_id, part in (("a", 0, 0), ("b", 0, 1), ("a", 1, 2), ("b", 0, 1)):
        table.commit(fold_state(writes.filter(f"seq % 3 = {part}")), writer, batch_id)
    return _shown(folded(table.read()))


@query("q_leads_pages", _STORE + "SELECT row_number() OVER (ORDER BY created_at, id) - 1 AS place, id, source_url FROM folded ORDER BY created_at, id LIMIT 300")
def q_leads_pages(spark, sf):
    """Three pages of a hundred leads in the table's order, each asked for after the last key of the one before."""
    table, pages, after = scratch_dir(spark, "ordered"), [], None
    stored = upsert_fold(_writes(spark, sf))
    publish_ordered(stored, table)
    for number in range(3):
        page = write_once(scan_page(spark, table, 100, after, stored.schema), "page")
        last = page.orderBy(F.desc("created_at"), F.desc("id")).first()
        after = (last.created_at, last.id) if last else after
        place = F.row_number().over(Window.orderBy("created_at", "id")) - 1 + 100 * number  # one page
        pages.append(page.select(place.cast("bigint").alias("place"), "id", "source_url"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("q_cached_mx", ctes("raw_mails", "mx_snapshot") + rf""", domains AS (SELECT DISTINCT lower(regexp_extract({o.trim('email')}, '(?s)^[^@]*@(.+)\z', 1)) AS domain, id % 2 AS half FROM raw_mails),
 known AS (SELECT domain, bool_or(half = 0) AS early FROM domains WHERE domain <> '' GROUP BY domain)
 SELECT k.domain, coalesce(m.outcome = 'timeout' OR m.n_mx > 0, false) AS mx_ok, NOT early OR coalesce(m.outcome = 'timeout', false) AS asked_again FROM known k LEFT JOIN mx_snapshot m ON m.domain = k.domain""")
def q_cached_mx(spark, sf):
    """Domains of half of the mails looked up by one run, then those of all mails by a second one, which asks for new ones and for those that timed out."""
    mails = derived(spark, sf, "raw_mails").select("id", mail_domain("email").alias("domain")).filter(F.col("domain") != "")
    table, ask = result_table(spark, scratch_dir(spark, "results"), "domain"), ask_domains(derived(spark, sf, "mx_snapshot"))
    cached_lookup(mails.filter("id % 2 = 0").select("domain"), table, ask, F.lit("2024-05-01").cast("timestamp"), "30 days")
    second = cached_lookup(mails.select("domain"), table, ask, F.lit("2024-05-20").cast("timestamp"), "30 days")
    return second.select("domain", F.col("value").alias("mx_ok"), F.col("asked").alias("asked_again"))


_SPLIT = "array_to_string(list_filter(string_split({c}, ','), lambda x: x <> ''), '|') AS {c}"


@query("q_leads_scan", _STORE + f"SELECT id, source_url, company_name AS raw_name, {_SPLIT.format(c='emails')}, {_SPLIT.format(c='telegram_handles')}, is_cis, cis_reason, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM folded WHERE is_cis")
def q_leads_scan(spark, sf):
    leads = scan_leads(_published(spark, sf), flagged_only=True)
    lists = [F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("emails", "telegram_handles")]
    return leads.select("id", "source_url", "raw_name", *lists, "is_cis", "cis_reason", utc_text("created_at").alias("created_at"))


@query("q_known_urls", _STORE + "SELECT DISTINCT source_url FROM folded")
def q_known_urls(spark, sf):
    return known_urls(_published(spark, sf))


@query("q_export_cumulative", _STORE + """SELECT id AS "ID", company_name AS "Company Name", source_url AS "Source URL", emails AS "Emails", telegram_handles AS "Telegram Handles", CASE WHEN tg_validation_status = '' THEN 'N/A' ELSE tg_validation_status END AS "TG Validation Status", linkedin AS "LinkedIn", skype AS "Skype",
 '' AS "Discord", twitter AS "Twitter", CAST(is_cis AS VARCHAR) AS "Is CIS", cis_reason AS "CIS Reason", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Created At" FROM folded""")
def q_export_cumulative(spark, sf):
    return flatten_stored(scan_leads(_published(spark, sf)))


# --- streams ---------------------------------------------------------------------------

def _run(stream) -> None:
    stream.awaitTermination()


def _upsert_in_parts(spark, writes: DataFrame, parts: int, log: str, writer: str) -> None:
    """Writes that arrive in parts, each a micro-batch of one stream, which stops after it and goes on from its checkpoint.

    A part stays in as many files as the input has splits, so no task writes or reads a whole batch.
    """
    incoming, state = scratch_dir(spark, "incoming"), scratch_dir(spark, "state")
    for part in range(parts):
        writes.filter(F.pmod(F.xxhash64("seq"), F.lit(parts)) == part).write.mode("append").parquet(incoming)
        _run(jobs.stream_upsert(jobs.stream_table(spark, incoming, writes.schema), log, state, writer))


@query("q_stream_first_seen", ctes("target_lines") + f" SELECT DISTINCT {_NORM} AS norm FROM target_lines WHERE {_NORM} <> ''")
def q_stream_first_seen(spark, sf):
    pages = jobs.stream_table(spark, f"{sf}/page[s].parquet", jobs.PAGES)  # a pattern may also name a single file
    kind = F.col("page_id") % 6
    listed = F.when(kind == 0, F.concat(F.lit("  "), F.upper("url"), F.lit(" "))).when(kind == 1, "").when(kind == 2, F.concat(F.lit("# "), "url")).otherwise(F.col("url"))
    lines = pages.select("page_id", F.posexplode(F.array(listed, F.col("url"))).alias("copy", "line"))
    out = scratch_dir(spark, "seen")
    _run(jobs.stream_to_files(jobs.stream_first_seen(lines.select("line"), "line"), out, scratch_dir(spark, "state")))
    return spark.read.parquet(out).select("norm")


@query("q_stream_upsert", _STORE + f"SELECT {', '.join(_COLUMNS)}, {_TIMES} FROM folded")
def q_stream_upsert(spark, sf):
    log, writes = scratch_dir(spark, "log"), _writes(spark, sf)
    _upsert_in_parts(spark, writes, 3, log, "orders")
    return _shown(upsert_fold(read_writes(spark, log, writes.schema)))


@query("q_two_writers", _STORE + f"SELECT {', '.join(_COLUMNS)}, {_TIMES} FROM folded")
def q_two_writers(spark, sf):
    """Two streams with checkpoints of their own on one log."""
    log, writes = scratch_dir(spark, "log"), _writes(spark, sf)
    for half in (0, 1):
        _upsert_in_parts(spark, writes.filter(f"seq % 2 = {half}"), 2, log, f"half{half}")
    return _shown(upsert_fold(read_writes(spark, log, writes.schema)))


@query("q_stream_known_anti", ctes("listing_links") + f" SELECT cat_ord, page_no, pos, link FROM listing_links WHERE link NOT IN ({_KNOWN})")
def q_stream_known_anti(spark, sf):
    incoming, out = scratch_dir(spark, "incoming"), scratch_dir(spark, "links")
    links = derived(spark, sf, "listing_links")
    links.repartition(3).write.parquet(incoming)
    stored = lambda s: s.read.parquet(f"{sf}/part.parquet").filter("p_size > 25").select(F.concat(F.lit("https://dir.example/n"), "p_partkey").alias("source_url"))
    _run(jobs.stream_without_known(jobs.stream_table(spark, incoming, links.schema, 1), stored, out, scratch_dir(spark, "state"), "links"))
    return spark.read.option("basePath", out).parquet(f"{out}/writer=*/batch_id=*").select("cat_ord", "page_no", "pos", "link")


@query("q_stream_first_seen_table", ctes("target_lines") + f" SELECT DISTINCT {_NORM} AS norm FROM target_lines WHERE {_NORM} <> ''")
def q_stream_first_seen_table(spark, sf):
    incoming, out = scratch_dir(spark, "incoming"), scratch_dir(spark, "seen")
    lines = derived(spark, sf, "target_lines").select("line", "ord")
    lines.repartition(3).write.parquet(incoming)
    stream = jobs.stream_table(spark, incoming, lines.schema, 1)
    _run(jobs.stream_first_seen_table(stream, "line", jobs.seen_keys(spark, scratch_dir(spark, "keys")), out, scratch_dir(spark, "state"), "lines"))
    return spark.read.option("basePath", out).parquet(f"{out}/writer=*/batch_id=*").select("norm")


@query("q_stream_unknown", ctes("listing_links") + f" SELECT cat_ord, page_no, pos, link FROM listing_links WHERE link NOT IN ({_KNOWN})")
def q_stream_unknown(spark, sf):
    incoming, out = scratch_dir(spark, "incoming"), scratch_dir(spark, "links")
    links = derived(spark, sf, "listing_links")
    links.repartition(2).write.parquet(incoming)
    table = VersionedTable(spark, scratch_dir(spark, "table"), "source_url", lambda rows: rows.distinct())
    table.commit(derived(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("https://dir.example/n"), "p_partkey").alias("source_url")), "parts", 0)
    _run(jobs.stream_unknown(jobs.stream_table(spark, incoming, links.schema, 1), table, out, scratch_dir(spark, "state"), "links"))
    return spark.read.option("basePath", out).parquet(f"{out}/writer=*/batch_id=*").select("cat_ord", "page_no", "pos", "link")
