"""Link listings: page links, pagination stop, ordered dedup over categories, known URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.entities import decode_entities
from leadweave.functions.lists import Col, col, ordered_unique
from leadweave.functions.urls import card_link
from leadweave.operators.tokens import attribute, attributes, visible_markup

HREF_TAG = r'(?i)<a\s(?:=\s*"[^"]*"|=\s*\'[^\']*\'|[^>])*+>'


def hrefs(html: Col) -> Column:
    """``href`` values of all ``a`` elements in document order."""
    tags = F.regexp_extract_all(visible_markup(html), F.lit(HREF_TAG), F.lit(0))
    values = F.transform(tags, lambda t: attribute(attributes(t), "href"))
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: decode_entities(v, in_attribute=True))


def page_links(pages: DataFrame, url: str = "url", html: str = "html",
               clean: Callable[[Col, Col], Column] = card_link) -> DataFrame:
    """Clean links of every page as rows (``pos``, ``link``), unique per page ignoring case.

    Works inside the page row, so nothing is shuffled.
    """
    cleaned = F.transform(hrefs(html), lambda h: clean(h, col(url)))
    links = ordered_unique(F.filter(cleaned, lambda v: v.isNotNull()))
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(links).alias("pos", "link"))


def pagination_stop(links: DataFrame) -> DataFrame:
    """Last page (``cat_ord``, ``last_page``) each category is read to.

    A category ends before its first page that brings no link new to it. The page numbers from 1 on form an
    unbroken run, so the last page is the smallest one whose successor brings nothing new: an anti join
    on (category, page) and a minimum. No task ever holds a whole category.
    """
    first = links.groupBy("cat_ord", "link").agg(F.min("page_no").alias("page_no"))
    fresh = first.select("cat_ord", F.col("page_no").cast("bigint").alias("page_no")).distinct()
    successors = fresh.select(F.col("cat_ord"), (F.col("page_no") - 1).alias("page_no"))
    starts = fresh.filter("page_no = 1").select("cat_ord", "page_no")
    ends = fresh.join(successors, ["cat_ord", "page_no"], "left_anti")
    last = ends.groupBy("cat_ord").agg(F.min("page_no").alias("last_page"))
    return last.join(starts.select("cat_ord"), "cat_ord", "left_semi")


def reached_links(links: DataFrame) -> DataFrame:
    """Links on pages that the pagination stop leaves in."""
    within = links.join(pagination_stop(links), "cat_ord", "left")
    return within.filter("page_no <= last_page").drop("last_page")


def discover(links: DataFrame) -> DataFrame:
    """Each link once, where it is first met: categories in order, pages ascending, links in page order.

    ``links`` has ``cat_ord, page_no, pos, link``. A link met in an earlier category is dropped here, after
    the stop was found, since it still counts as new for its own category.
    """
    place = F.struct("cat_ord", "page_no", "pos")
    first = reached_links(links).groupBy("link").agg(F.min(place).alias("place"))
    return first.select("place.cat_ord", "place.page_no", "place.pos", "link")


def without_known(found: DataFrame, known: DataFrame) -> DataFrame:
    """Drop links already stored (exact match). Apply after :func:`discover`."""
    return found.join(known.select(F.col("source_url").alias("link")), "link", "left_anti")


