"""Character references in HTML text, decoded with built-in functions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column

from leadweave.functions.lists import Col, let_sql, sql_text

# Names that also count without ';', longest first, from the standard library's HTML 5 table.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;|(?:{bare}))"

_BARE_NAMED = sql_text("\x02".join(f"{name}\x01{value}" for name, value in html5.items() if not name.endswith(";")))
_NAMED = sql_text("\x02".join(f"{name}\x01{value}" for name, value in html5.items()))
# HTML 5 reads the code points 0x80-0x9F as windows-1252 bytes.
_C1 = sql_text("".join(bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)))

_DIGITS = "regexp_extract(r, '^&#[xX]?([0-9a-fA-F]+)', 1)"
_POINT = f"CASE WHEN length(ltrim('0', {_DIGITS})) <= 7 THEN try_cast(CASE WHEN r RLIKE '^&#[xX]' THEN conv({_DIGITS}, 16, 10) ELSE {_DIGITS} END AS BIGINT) END"
_NUMERIC = f"""transform(array({_POINT}), n ->
  CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '\\ufffd'
       WHEN n BETWEEN 128 AND 159 THEN substring({_C1}, CAST(n - 127 AS INT), 1)
       ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END)[0]"""
_KNOWN = "try_element_at(str_to_map({named}, '\\u0002', '\\u0001'), {name})"
_BY_NAME = _KNOWN.format(named=_NAMED, name="substring(r, 2)")


def _decode(skip: str, in_attribute: bool) -> str:
    # an unknown name with ';' may begin with a known one without; in attributes that counts only if no '=', letter or digit follows
    bare = f"(?:{_BARE})(?![=a-zA-Z0-9])" if in_attribute else _BARE
    reference = _REFERENCE.format(bare=bare)
    start = f"regexp_extract(r, '^&({bare})', 1)"
    by_start = f"transform(array({start}), s -> CASE WHEN s <> '' THEN concat({_KNOWN.format(named=_BARE_NAMED, name='s')}, substring(r, length(s) + 2)) END)[0]"
    value = f"nullif(CASE WHEN startswith(r, '&#') THEN {_NUMERIC} ELSE coalesce({_BY_NAME}, {by_start}) END, '')"
    # the text in pieces; each distinct reference is looked up once, and no piece is read twice
    return f"""
x -> CASE WHEN contains(x, '&') THEN
  transform(array(regexp_extract_all(x, '{reference}|[^&]+|&', 0)), pieces ->
    transform(array(filter(transform(array_distinct(filter(pieces, p -> startswith(p, '&') AND length(p) > 1)), r -> named_struct('ref', r, 'value', {value})),
                           p -> p.value IS NOT NULL AND p.value NOT IN ({skip}))), known ->
      transform(array(map_from_arrays(known.ref, known.value)), table ->
        array_join(transform(pieces, p -> coalesce(try_element_at(table, p), p)), ''))[0])[0])[0]
ELSE x END
"""


_MARKUP = "'&', '<', '>', '\"', '\\''"
_FORMS = {(keep, attr): _decode(_MARKUP if keep else "''", attr) for keep in (False, True) for attr in (False, True)}


def decode_entities(c: Col, keep_markup: bool = False, in_attribute: bool = False) -> Column:
    """Replace character references by their text, as a browser reads them in text or, with ``in_attribute``, in attribute values.

    ``keep_markup`` leaves those that stand for ``& < > " '``, as a serialised page has them.
    """
    return let_sql(c, _FORMS[keep_markup, in_attribute])
