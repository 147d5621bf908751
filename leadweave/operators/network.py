"""Network metadata and manager records of directory pages (layouts A and B).

Every step works inside the page's row: a page's tree comes from :mod:`leadweave.operators.page_tree`, and rows, terms, blocks and managers
are arrays made from it. No page is moved, sorted or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.entities import decode_entities
from leadweave.functions.lists import let, literals, ordered_unique
from leadweave.functions.text import collapse_space, emails, skype_ids, telegram_handles, trim_space
from leadweave.operators.page_tree import page_tree, token_codes
from leadweave.operators.tokens import attribute, attributes, page_tokens, token_text

_NAME_PLACES = (".name", ".manager-name", "strong", "b", "h3", "h4")
_FIELDS = ("commission_type", "payment_frequency", "minimum_payout", "referral_rate")


def metadata_field(label: Column) -> Column:
    """Field a cleaned, lowered label stands for; NULL for none. The first case that holds wins."""
    return (
        F.when(label.contains("commission") | label.contains("payout model") | label.contains("payment model"), "commission_type")
        .when(label.contains("frequency") | label.contains("payment terms"), "payment_frequency")
        .when(label.contains("minimum") & label.contains("payout"), "minimum_payout")
        .when(label.contains("referral"), "referral_rate")
    )


def _contact_values(raw: Column, tag: Column, layout: Column) -> Column:
    """Attribute values of an opening tag that may hold manager contacts, one per line.

    No contact pattern crosses a line break, so one pass over the lines finds what a pass per value would.
    """

    def values(pieces: Column) -> Column:
        found = {n: attribute(pieces, n) for n in fixed.MANAGER_ATTRIBUTES_B}
        selected = (
            found["data-email"].isNotNull() | found["data-tippy"].isNotNull() | found["title"].isNotNull()
            | ((tag == "a") & found["href"].isNotNull())
        )
        meta = (tag == "meta") & found["content"].isNotNull()
        of_a = F.concat_ws("\n", *[found[n] for n in fixed.MANAGER_ATTRIBUTES_A])
        of_b = F.concat_ws("\n", *[found[n] for n in fixed.MANAGER_ATTRIBUTES_B])
        return F.when((layout == "A") & selected, of_a).when((layout == "B") & (selected | meta), of_b).otherwise("")

    low = F.lower(raw)
    named = low.contains(fixed.MANAGER_ATTRIBUTES_B[0])
    for name in fixed.MANAGER_ATTRIBUTES_B[1:]:
        named = named | low.contains(name)
    return F.when(named, decode_entities(let(attributes(raw), values), in_attribute=True)).otherwise("")


def _places(raw: Column, tag: Column) -> Column:
    """Numbers of the manager-name selectors an opening tag meets."""
    classes = F.split(F.coalesce(attribute(attributes(raw), "class"), F.lit("")), r"\s+")
    by_class = F.when(raw.contains("name"), F.transform(classes, lambda c: F.array_position(literals([p[1:] if p[0] == "." else "" for p in _NAME_PLACES]), c)))
    by_tag = F.array_position(literals(_NAME_PLACES), tag)
    return F.filter(F.concat(F.coalesce(by_class, F.array().cast("array<bigint>")), F.array(by_tag)), lambda i: i > 0)


_MARK = "array<struct<ord:int,tag:string,start:int,end:int,last:int,next:int,i:int>>"


def page_structure(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (``page_id, layout`` if not given) with ``marks``, the elements of the page in tree order, ``raws``, its tokens as
    written, and ``texts``, its texts in tree order; ``page_error`` says why a page has no tree.

    ``pages`` has ``layout, html`` too. A mark holds the token ``ord`` of its tag (-1: implied), its range ``start`` to ``end`` of texts, the place ``last``
    after its last descendant, its ``next`` sibling (-1: none) and its own place ``i``. Pages without a row or term get marks only if they
    have items or divs and their text names a manager.
    """
    labelled = F.col("html").rlike(r"(?i)<(?:table|t[rdh]|dt)[\s/>]")
    blocks = F.col("html").rlike(r"(?i)<(?:li|div)[\s/>]")
    keep = keep or ["page_id", "layout"]
    cut = pages.select(*keep, F.when(labelled | blocks, page_tokens("html")).alias("raws"), labelled.alias("labelled"))
    read = cut.select("*", F.transform("raws", token_text).alias("spoken"))
    worth = F.col("labelled") | _speaks(F.array_join("spoken", ""), F.col("layout"))
    built = read.select(*keep, "raws", "spoken", page_tree()(F.when(worth, token_codes("raws"))).alias("tree"))
    marks = F.arrays_zip(*[F.col(f"tree.{f}") for f in ("ord", "tag", "start", "end", "last", "next", "i")]).cast(_MARK)
    return built.select(*keep, marks.alias("marks"), "raws", F.transform("tree.texts", lambda i: F.get("spoken", i)).alias("texts"), F.col("tree.error").alias("page_error"))


def _text_of(texts: Column, element: Column) -> Column:
    """The texts an element holds, joined without separator."""
    return F.array_join(F.slice(texts, element["start"] + 1, element["end"] - element["start"]), "")


def _within(marks: Column, element: Column) -> Column:
    return F.slice(marks, element["i"] + 2, element["last"] - element["i"] - 1)


def key_value_rows(marks: Column, texts: Column) -> Column:
    """First two cells of every table row that has two: ``array<struct<ord, label, value>>``."""

    def pair(row: Column) -> Column:
        cells = F.slice(F.filter(_within(marks, row), lambda t: t["tag"].isin("td", "th")), 1, 2)
        return let(cells, lambda c: F.when(F.size(c) == 2, F.struct(
            row["i"].alias("ord"), _text_of(texts, F.get(c, F.lit(0))).alias("label"), _text_of(texts, F.get(c, F.lit(1))).alias("value"))))

    return F.filter(F.transform(F.filter(marks, lambda t: t["tag"] == "tr"), pair), lambda p: p.isNotNull())


def key_value_pairs(marks: Column, texts: Column) -> Column:
    """Every ``dt`` with the text of the element that follows it: ``array<struct<ord, label, value>>``."""

    def pair(term: Column) -> Column:
        value = F.when(term["next"] >= 0, _text_of(texts, F.get(marks, term["next"]))).otherwise("")
        return F.struct(term["i"].alias("ord"), _text_of(texts, term).alias("label"), value.alias("value"))

    return F.transform(F.filter(marks, lambda t: t["tag"] == "dt"), pair)


def metadata(rows: Column, pairs: Column) -> Column:
    """Fold labelled values into one struct: later ones win, all table rows come before all term pairs."""
    named = F.transform(F.concat(rows, pairs), lambda p: F.struct(
        metadata_field(F.lower(collapse_space(p["label"]))).alias("field"), collapse_space(p["value"]).alias("value")))

    def fold(kept: Column) -> Column:
        def last(field: str) -> Column:
            hits = F.filter(kept, lambda p: p["field"] == field)
            return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit("")).alias(field)

        return F.struct(*[last(f) for f in _FIELDS])

    return let(F.filter(named, lambda p: p["field"].isNotNull() & (p["value"] != "")), fold)


# a phrase is in the collapsed text when its words stand in the text with any white space between them
_SPACED = {lay: "(?i)" + "|".join(p.replace(" ", fixed.SPACE_CLASS + "+") for p in phrases)
           for lay, phrases in (("A", fixed.MANAGER_PHRASES_A), ("B", fixed.MANAGER_PHRASES_B))}


def _speaks(text: Column, layout: Column) -> Column:
    return F.when(layout == "B", text.rlike(_SPACED["B"])).otherwise(text.rlike(_SPACED["A"]))


def manager_blocks(marks: Column, texts: Column, layout: Column) -> Column:
    """Rows, list items and divs that speak of a manager, with their mark and ``text``; nested ones all count.

    A block's text is part of the page's, so pages that nowhere hold one of the phrases are passed over.
    """

    opened = F.filter(marks, lambda t: t["tag"].isin("tr", "li", "div"))
    spans = F.transform(opened, lambda b: F.struct(b["i"].alias("ord"), b.alias("mark"), _text_of(texts, b).alias("text")))
    found = F.transform(F.filter(spans, lambda b: _speaks(b["text"], layout)), lambda b: b.withField("text", collapse_space(b["text"])))
    return F.when(_speaks(F.array_join(texts, ""), layout), found)


def block_managers(marks: Column, raws: Column, texts: Column, layout: Column, blocks: Column) -> Column:
    """Name and contacts of every block that gives a name: ``array<struct<ord, name, emails, skype, telegram>>``."""

    def manager(b: Column) -> Column:
        return let(F.transform(_within(marks, b["mark"]), lambda t: F.struct(t.alias("mark"), F.get(raws, t["ord"]).alias("raw"))), lambda inner: record(b, inner))

    def record(b: Column, inner: Column) -> Column:
        # the first element of each selector, selectors in order; the first of those with any text gives the name
        met = F.flatten(F.transform(inner, lambda t: F.transform(_places(t["raw"], t["mark"]["tag"]), lambda p: F.struct(p.alias("place"), t["mark"].alias("mark")))))
        firsts = let(F.sort_array(met), lambda ms: F.filter(ms, lambda e, j: (j == 0) | (F.get(ms, j - 1)["place"] != e["place"])))
        spoken = F.filter(F.transform(firsts, lambda e: trim_space(_text_of(texts, e["mark"]))), lambda v: v != "")
        head = F.when(b["text"].contains(":"), F.btrim(F.substring_index(b["text"], ":", 1))).otherwise("")
        name = F.coalesce(F.get(spoken, F.lit(0)), head)
        lines = F.array_join(F.transform(inner, lambda t: _contact_values(t["raw"], t["mark"]["tag"], layout)), "\n")
        return let(lines, lambda v: F.struct(
            b["ord"].alias("ord"), name.alias("name"), emails(v).alias("emails"),
            skype_ids(v).alias("skype"), telegram_handles(v).alias("telegram")))

    return F.filter(F.transform(blocks, manager), lambda m: m["name"] != "")


def merged_managers(managers: Column) -> Column:
    """Managers of one page with the same name ignoring case as one, in order of first appearance: the first spelling, lists united in
    order; an empty list is filled from the name and the other lists."""

    def united(same: Column) -> Column:
        lists = {c: ordered_unique(F.flatten(F.transform(same, lambda m: m[c]))) for c in ("emails", "skype", "telegram")}
        return F.struct(F.get(same, F.lit(0))["name"].alias("name"), *[v.alias(c) for c, v in lists.items()])

    def refilled(m: Column) -> Column:
        line = F.concat_ws(" ", m["name"], *[F.array_join(m[c], " ") for c in ("emails", "skype", "telegram")])
        filled = {c: F.when(F.size(m[c]) == 0, found(line)).otherwise(m[c]) for c, found in (("emails", emails), ("skype", skype_ids), ("telegram", telegram_handles))}
        return F.struct(m["name"].alias("name"), *[v.alias(c) for c, v in filled.items()])

    names = F.array_distinct(F.transform(managers, lambda m: F.lower(m["name"])))
    return F.transform(F.transform(names, lambda n: let(F.filter(managers, lambda m: F.lower(m["name"]) == n), united)), refilled)


def network_records(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``page_id, layout, carry..., network, page_error`` per page (``page_id, layout, html``); ``network`` is NULL for the default layout."""
    keep = ["page_id", "layout", *(carry or [])]
    marks, raws, texts, layout = (F.col(c) for c in ("marks", "raws", "texts", "layout"))
    read = page_structure(pages, keep).select(
        *keep, "page_error", metadata(key_value_rows(marks, texts), key_value_pairs(marks, texts)).alias("meta"),
        F.coalesce(block_managers(marks, raws, texts, layout, manager_blocks(marks, texts, layout)), F.array()).alias("found"))
    network = F.struct("meta.*", merged_managers(F.col("found")).alias("managers"))
    return read.select(*keep, F.when(layout.isin("A", "B"), network).alias("network"), "page_error")
