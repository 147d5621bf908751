"""HTML pages as tokens: one pattern cuts a page, and what a token adds to the page's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions.entities import decode_entities
from leadweave.functions.lists import Col, col

# quotes count inside a tag only after '='
INSIDE = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes|noscript"
# text, or what a '<' starts: comment, element whose body is not markup, tag, declaration; else the '<' is text
TOKEN = (
    r"(?is)[^<]++|<(?:!--.*?(?:-->|\z)"
    rf"|({_RAW})(?=[\s/>]){INSIDE}>.*?(?=</\1|\z)"
    rf"|/?[a-z]{INSIDE}>"
    r"|[!?/][^>]*>)?"
)
_HIDDEN = rf"(?is)<(?:!--.*?(?:-->|\z)|(script|style|textarea|xmp|iframe|noembed|noframes|noscript)(?=[\s/>]){INSIDE}>.*?(?:</\1\s*>|\z))"
RAW_BODY = r"(?i)^<(?:script|style|xmp|iframe|noembed|noframes|noscript)[\s/>]"
_ATTRIBUTE = r"""(?s)[^\s=/>"'][^\s=/>]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?"""


def visible_markup(html: Col) -> Column:
    """HTML without comments and without elements whose body is not markup."""
    return F.regexp_replace(col(html), _HIDDEN, "")


def attributes(tag: Col) -> Column:
    """``name="value"`` pieces of an opening tag, in order."""
    return F.regexp_extract_all(F.regexp_replace(col(tag), r"^<[^\s/>]+", ""), F.lit(_ATTRIBUTE), F.lit(0))


def attribute(pieces: Column, name: str) -> Column:
    """Raw value of the first attribute of that name; '' without value, NULL when absent."""
    piece = F.get(F.filter(pieces, lambda p: p.rlike(rf"(?is)^{name}(?:\s*=.*)?\z")), F.lit(0))
    value = F.when(piece.contains("="), F.regexp_replace(piece, r"(?s)^[^=]*=\s*", "")).otherwise(F.when(piece.isNotNull(), ""))
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1\z""", "$2")


def inner_text(html: Column, tag: str) -> Column:
    """Text of the first element of that name: tags dropped, references decoded, ends trimmed by the caller."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?=[\s/>]){INSIDE}>(.*?)(?:</{tag}\s*>|\z)", 1)
    return decode_entities(F.regexp_replace(inner, rf"(?i)</?[a-z]{INSIDE}>", ""))


def page_tokens(html: Col) -> Column:
    """All tokens of a page as written; joined they give the page again."""
    return F.regexp_extract_all(col(html), F.lit(TOKEN), F.lit(0))


def token_text(raw: Column) -> Column:
    """Text a token adds to the page: decoded text, or the body of an element that holds no markup; '' for tags and comments."""
    decoded = F.when(raw.contains("&"), decode_entities(raw)).otherwise(raw)
    body = F.regexp_replace(raw, rf"(?is)^<[a-z]{INSIDE}>", "")
    return (
        F.when(~raw.startswith("<") | (raw == "<"), decoded)
        .when(raw.rlike(r"(?i)^<(?:title|textarea)[\s/>]"), decode_entities(body))
        .when(raw.rlike(RAW_BODY), body).otherwise("")
    )
