"""URL columns: ids, hosts, page URLs, and cleaning of listing links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.lists import Col, col, let, literals
from leadweave.functions.text import is_noise, trim_space

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
# scheme or none, user, host or bracketed address, port of digits only
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\[\]/?#]*\]|[^\[\]:/?#]*)(?::[0-9]*)?(?=[/?#]|\z)"
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_BAD_ESCAPE = r"%(?![0-9a-fA-F]{2})"
_CONTROL = r"[\x00-\x1f\x7f]"
# a path made of these only is kept as written; any other is decoded and escaped anew
_PLAIN_PATH = r"^(?:[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]]|%[0-9a-fA-F]{2})*+\z"


def lead_id(url: Col) -> Column:
    return F.sha2(col(url), 256)


def source_domain(url: Col) -> Column:
    """Lower-case host without port, an IPv6 address without its brackets; '' when the text names no host or a port that is no number."""
    url = col(url)
    host = F.btrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("[]"))
    broken = host.rlike(fixed.SPACE_CLASS) | url.rlike(_CONTROL) | F.regexp_extract(url, r"^([^?#]*)", 1).rlike(_BAD_ESCAPE)
    return F.when(broken, F.lit("")).otherwise(host)


def route_host(url: Col) -> Column:
    """Host as the route table spells it: trimmed URL, lower case, one trailing dot removed."""
    return F.regexp_replace(source_domain(trim_space(url)), r"\.\z", "")


def url_problem(url: Col) -> Column:
    """Reason why a target cannot be used, NULL when it can."""
    url = col(url)
    text = F.concat(F.lit('target URL "'), F.coalesce(url, F.lit("")), F.lit('" must include a scheme and host'))
    usable = (route_host(url) != "") & trim_space(url).rlike(_SCHEME)
    return F.when(~F.coalesce(usable, F.lit(False)), text)


def _parts(url: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(url, _PARTS, 1)).alias("scheme"), F.regexp_extract(url, _PARTS, 2).alias("authority"),
        F.regexp_extract(url, _PARTS, 3).alias("path"), F.regexp_extract(url, _PARTS, 4).alias("query"),
    )


def _host_of(authority: Column) -> Column:
    return F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))


def _unescape_path(path: Column) -> Column:
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), F.coalesce(decoded, path)).otherwise(path)


def _escape_path(path: Column) -> Column:
    escaped = F.url_encode(_unescape_path(path))
    for encoded, plain in (
        ("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
        ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~"),
    ):
        escaped = F.replace(escaped, F.lit(encoded), F.lit(plain))
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(escaped)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    steps = F.split(F.regexp_replace(path, "(?s)^.", ""), "/")
    none = F.array().cast("array<string>")

    def step(seen: Column, part: Column) -> Column:
        up = F.when(F.size(seen) > 0, F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(none)
        return F.when(part == ".", seen).when(part == "..", up).otherwise(F.concat(seen, F.array(part)))

    folded = F.array_join(F.aggregate(steps, none, step), "/")
    tail = F.when(path.rlike(r"/\.{1,2}\z") & (folded != ""), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.{1,2}(?:/|\z)"), F.concat(F.lit("/"), folded, tail)).otherwise(path)


def _resolve(ref: Column, base: Column) -> Column:
    """Absolute form of a reference against its page, as struct(scheme, authority, path)."""
    own = (ref["scheme"] != "") | (ref["authority"] != "")
    folder = F.regexp_extract(base["path"], r"(?s)^(.*/)", 1)
    joined = (
        F.when(own | ref["path"].startswith("/"), ref["path"])
        .when(ref["path"] == "", base["path"])
        .otherwise(F.concat(folder, ref["path"]))
    )
    rooted = let(joined, lambda p: F.when((p == "") | p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    return F.struct(
        F.when(ref["scheme"] != "", ref["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        F.when(own, ref["authority"]).otherwise(base["authority"]).alias("authority"),
        let(rooted, lambda p: _escape_path(_fold_dots(p))).alias("path"),
    )


def _card_path(path: Column) -> Column:
    def test(segment: Column) -> Column:
        return (
            (segment != "") & ~segment.contains("/") & ~F.array_contains(literals(fixed.CARD_PATH_BLACKLIST), segment)
            & ~segment.startswith("page-") & ~is_noise(segment)
        )

    return let(F.lower(F.btrim(_unescape_path(path), F.lit("/"))), test)


def _profile_path(path: Column) -> Column:
    def test(segments: Column) -> Column:
        second = F.coalesce(F.get(segments, F.lit(1)), F.lit(""))
        return (F.lower(F.get(segments, F.lit(0))) == fixed.PROFILE_SEGMENT) & (second != "")

    return let(F.split(F.btrim(_unescape_path(path), F.lit("/")), "/"), test)


def _clean_link(href: Column, base: Column, path_test: Callable[[Column], Column]) -> Column:
    def resolved(h: Column) -> Column:
        skip = (h == "") | h.startswith("#") | F.lower(h).rlike(r"^(?:javascript|mailto):")
        return F.when(skip | h.rlike(_CONTROL), F.lit(None)).otherwise(
            let(F.struct(_parts(h).alias("ref"), _parts(base).alias("base")), lambda p: pick(p["ref"], p["base"])))

    def pick(ref: Column, base: Column) -> Column:
        unreadable = ref["path"].rlike(_BAD_ESCAPE) | ((ref["scheme"] == "") & (ref["authority"] == "") & ref["path"].rlike(r"^[^/]*:"))
        opaque = (ref["scheme"] != "") & (ref["authority"] == "") & ~ref["path"].startswith("/")
        return F.when(unreadable | opaque, F.lit(None)).otherwise(let(_resolve(ref, base), lambda r: same_site(r, base)))

    def same_site(link: Column, base: Column) -> Column:
        ok = (_host_of(link["authority"]) == _host_of(base["authority"])) & path_test(link["path"])
        return F.when(ok, F.concat(link["scheme"], F.lit("://"), link["authority"], link["path"]))

    return let(trim_space(href), resolved)


def card_link(href: Col, page_url: Col) -> Column:
    """Same-host link with exactly one usable path segment, without query and fragment; else NULL."""
    return _clean_link(col(href), col(page_url), _card_path)


def profile_link(href: Col, page_url: Col) -> Column:
    """Same-host ``/network/<slug>`` link, without query and fragment; else NULL."""
    return _clean_link(col(href), col(page_url), _profile_path)


def _query_escape(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def page_url(category_url: Col, page_no: Col) -> Column:
    """Category URL with ``page`` set: parameters sorted by key, fragment dropped."""

    def build(u: Column) -> Column:
        fields = F.filter(F.split(u["query"], "&"), lambda v: (v != "") & ~v.contains(";"))
        pairs = F.transform(fields, lambda v, i: F.struct(
            F.try_url_decode(F.regexp_extract(v, r"^([^=]*)", 1)).alias("k"), i.alias("i"),
            F.try_url_decode(F.regexp_extract(v, r"(?s)^[^=]*=(.*)\z", 1)).alias("v")))
        others = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["k"] != "page"))
        own = F.struct(F.lit("page").alias("k"), F.lit(0).alias("i"), col(page_no).cast("string").alias("v"))
        encoded = F.transform(F.sort_array(F.concat(others, F.array(own))),
                              lambda p: F.concat(_query_escape(p["k"]), F.lit("="), _query_escape(p["v"])))
        return F.concat(u["scheme"], F.lit("://"), u["authority"], _escape_path(u["path"]), F.lit("?"), F.array_join(encoded, "&"))

    return let(_parts(trim_space(category_url)), build)
