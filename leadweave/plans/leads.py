"""From captured pages to classified, verified leads."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.entities import decode_entities
from leadweave.functions.lists import Col, col, let
from leadweave.functions.rules import MailRules, NameRules, classify
from leadweave.functions.text import extract_contacts, trim_space
from leadweave.functions.urls import lead_id, route_host, url_problem
from leadweave.operators.dedup import dedup_key
from leadweave.operators.lookups import verify_domains, verify_handles
from leadweave.operators.network import network_records
from leadweave.operators.summary import run_summary
from leadweave.operators.tokens import INSIDE, RAW_BODY, attribute, attributes, inner_text, page_tokens, visible_markup
from leadweave.session import write_once

_TITLE = rf"(?is)<title(?=[\s/>]){INSIDE}>(.*?)(?:</title\s*>|\z)"
_META = rf"(?i)<meta(?=[\s/>]){INSIDE}>"


DEFAULT_ROUTES = dict(fixed.DEFAULT_ROUTES)


def with_layout(pages: DataFrame, routes: Mapping[str, str] | DataFrame, url: str = "url") -> DataFrame:
    """Add ``layout`` by the page's host; hosts without a route are 'default'.

    Routes given as a mapping become a literal and no row moves. A route table is joined as Spark sees fit; of a host
    listed more than once the least layout holds.
    """
    named = pages.withColumn("__host", route_host(url))
    if isinstance(routes, DataFrame):
        table = routes.groupBy(F.col("host").alias("__host")).agg(F.min("layout").alias("layout"))
        named = named.join(table, "__host", "left")
        layout = F.col("layout")
    else:
        pairs = [F.lit(v) for pair in routes.items() for v in pair]
        layout = F.try_element_at(F.create_map(*pairs), F.col("__host")) if pairs else F.lit(None).cast("string")
    return named.withColumn("layout", F.coalesce(layout, F.lit("default"))).drop("__host")


def page_title(markup: Col) -> Column:
    """First title with any text."""
    titles = F.transform(F.regexp_extract_all(col(markup), F.lit(_TITLE), F.lit(1)), lambda t: trim_space(decode_entities(t)))
    return F.coalesce(F.get(F.filter(titles, lambda t: t != ""), F.lit(0)), F.lit(""))


def _first_title(markup: Col) -> Column:
    return trim_space(decode_entities(F.regexp_extract(col(markup), _TITLE, 1)))


def _metas(markup: Col) -> Column:
    return F.transform(F.regexp_extract_all(col(markup), F.lit(_META), F.lit(0)), attributes)


def _og_title(markup: Col) -> Column:
    first = F.get(F.filter(_metas(markup), lambda m: attribute(m, "property") == "og:title"), F.lit(0))
    return trim_space(decode_entities(F.coalesce(let(first, lambda m: attribute(m, "content")), F.lit("")), in_attribute=True))


def company_name(markup: Col, layout: Col) -> Column:
    """Name of the page's company by layout; ``markup`` is the page without comments and scripts."""
    markup, layout = col(markup), col(layout)
    heading = F.nullif(trim_space(inner_text(markup, "h1")), F.lit(""))
    return (
        F.when(layout == "A", F.coalesce(heading, _first_title(markup)))
        .when(layout == "B", F.coalesce(heading, F.nullif(_og_title(markup), F.lit("")), _first_title(markup)))
        .otherwise(page_title(markup))
    )


def scanned_text(html: Col, layout: Col, markup: Col) -> Column:
    """Text that contacts are looked for in: the whole page with references decoded; layout B adds its meta contents."""
    html = col(html)
    contents = F.filter(F.transform(_metas(markup), lambda m: attribute(m, "content")), lambda v: v.isNotNull())
    # a script-like body is not decoded; token by token is only needed where hidden parts hold an '&' at all
    hidden = F.length(F.replace(html, F.lit("&"), F.lit(""))) - F.length(html) != F.length(F.replace(col(markup), F.lit("&"), F.lit(""))) - F.length(col(markup))
    pieces = F.transform(page_tokens(html), lambda t: F.when(t.rlike(RAW_BODY), t).otherwise(decode_entities(t, keep_markup=True, in_attribute=True)))
    whole = F.when(hidden, F.array_join(pieces, "")).otherwise(decode_entities(html, keep_markup=True, in_attribute=True))
    return F.when(col(layout) == "B", F.concat_ws(" ", whole, decode_entities(F.array_join(contents, " "), in_attribute=True))).otherwise(whole)


def lead_core(routed: DataFrame) -> DataFrame:
    """Compact lead columns out of pages with a layout, next to ``html``. Narrow, no shuffle."""
    visible = routed.select("page_id", "url", "layout", "html", visible_markup("html").alias("markup"))
    scanned = visible.withColumn("scanned", scanned_text("html", "layout", "markup"))
    return scanned.withColumn("low", F.lower("scanned")).select(
        "page_id", "layout", "html", lead_id("url").alias("id"), F.col("url").alias("source_url"),
        company_name("markup", "layout").alias("company_name"), extract_contacts("scanned", "low").alias("contacts"),
    )


def first_targets(pages: DataFrame) -> DataFrame:
    """``page_id`` of the first page of every URL, from the two narrow columns only. Blank and missing URLs are one target."""
    keyed = pages.select("page_id", F.coalesce(dedup_key("url"), F.lit("")).alias("k"))
    return keyed.groupBy("k").agg(F.min("page_id").alias("page_id")).select("page_id")


def leads_from_pages(pages: DataFrame, routes: Mapping[str, str] | DataFrame = DEFAULT_ROUTES, winners: DataFrame | None = None) -> DataFrame:
    """One lead per page (``page_id, url, html``); with ``winners`` (``page_id``) only for those pages.

    Pages that are no winner are left out before anything is extracted; everything after that happens inside the page's row. ``network`` is NULL
    for the default layout; ``page_error`` says why a page could not be read.
    """
    usable = pages.filter(url_problem("url").isNull())
    if winners is not None:
        usable = _only(usable, winners)
    core = lead_core(with_layout(usable, routes)).withColumn("uncaptured", F.when(F.col("html").isNull(), F.lit(UNCAPTURED)))
    nested = core.withColumn("html", F.when(F.col("layout").isin("A", "B"), F.col("html")))
    leads = network_records(nested, ["id", "source_url", "company_name", "contacts", "uncaptured"])
    return leads.withColumn("raw_name", F.col("company_name")).withColumn("page_error", F.coalesce("uncaptured", "page_error")).drop("uncaptured")


BROADCAST_ROWS = 1_000_000
UNCAPTURED = "the page was not captured"


def _only(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """Pages among the winners. Repeated targets are few as a rule: their ids, counted, are broadcast against pages that then stay where they
    are; are there more, both sides are joined by id, which moves each page once."""
    losers = write_once(pages.select("page_id").join(winners, "page_id", "left_anti"), "losers")
    if losers.count() <= BROADCAST_ROWS:
        return pages.join(F.broadcast(losers), "page_id", "left_anti")
    return pages.join(winners, "page_id", "left_semi")


class LeadRun(NamedTuple):
    leads: DataFrame
    rejects: DataFrame
    summary: DataFrame


def rejects(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """``page_id, url, stage, reason`` of first-seen targets whose URL cannot be used."""
    bad = pages.select("page_id", "url", url_problem("url").alias("reason")).filter(F.col("reason").isNotNull())
    return bad.join(winners, "page_id", "left_semi").select("page_id", "url", F.lit("route").alias("stage"), "reason")


def _failure() -> Column:
    """The first stage that failed on a lead, with the reason; NULL if none did. Reading ids that name two URLs is the caller's, see ``id_clashes``."""
    stages = {"extract": F.col("page_error"), "lookup": F.col("lookup_error"), "write": F.when(F.col("id").isNull() | F.col("source_url").isNull(), F.lit("a lead without id or URL"))
              .when(F.col("taken").isNotNull(), F.concat(F.lit("the id belongs to "), F.col("taken")))}
    return F.coalesce(*[F.when(reason.isNotNull(), F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))) for stage, reason in stages.items()])


def run_leads(pages: DataFrame, routes: Mapping[str, str] | DataFrame = DEFAULT_ROUTES, *, mail: MailRules | None, names: NameRules | None,
              handle_snapshot: DataFrame | None = None, mx_snapshot: DataFrame | None = None,
              created_at: Column | None = None, stored_leads: DataFrame | None = None) -> LeadRun:
    """The whole run: dedup targets, extract, classify, verify, summarise.

    No target's failure stops the run. Each lead carries what failed on it, if anything, as value next to its other columns; at the end leads are split
    into those without failure and ``rejects``: stage ``route`` (URL unusable), ``extract`` (page not captured or not readable), ``lookup`` (a handle could
    not be looked up), ``write`` (its id belongs to another URL of ``stored_leads``, ``id, source_url``).

    Classification sees the handles that verification may drop later. Rule sets must be named by the caller. The extracted leads
    are written once to the shared scratch folder; lookups and summary read that compact table, so no page is read again.
    """
    repeated = pages.groupBy("page_id").count().filter("count > 1").first()
    if repeated:  # two pages of one id would mix
        raise ValueError(f"page_id {repeated.page_id} names more than one page")
    winners = first_targets(pages)
    found = leads_from_pages(pages, routes, winners)
    flagged = classify(found, mail, names).withColumn("created_at", F.current_timestamp() if created_at is None else created_at)
    stored = write_once(flagged, "leads")
    checked = verify_domains(verify_handles(stored, handle_snapshot, "page_id"), mx_snapshot, "page_id")
    if stored_leads is None:
        checked = checked.withColumn("taken", F.lit(None).cast("string"))
    else:
        owners = stored_leads.groupBy("id").agg(F.min("source_url").alias("owner"))
        checked = checked.join(owners, "id", "left").withColumn("taken", F.when(F.col("owner") != F.col("source_url"), F.col("owner"))).drop("owner")
    judged = checked.withColumn("failure", _failure())
    leads = judged.filter(F.col("failure").isNull()).drop("failure", "taken", "lookup_error", "page_error")
    failed = judged.filter(F.col("failure").isNotNull()).select("page_id", F.col("source_url").alias("url"), "failure.stage", "failure.reason")
    # a lead counts as extracted as soon as its page was read, whatever fails on it later
    extracted = judged.filter("page_error IS NULL")
    return LeadRun(leads, rejects(pages, winners).unionByName(failed), run_summary(pages, extracted))
