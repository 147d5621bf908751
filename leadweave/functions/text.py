"""Text and list columns: contact extraction, token cleaning, list and status texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.lists import Col, col, empty_list, ordered_unique

HANDLE_SHAPE = r"^(?:https://)?(?:http://)?(?:www\.)?(?:t\.me/)?(?:telegram\.me/)?(?:telegram\.dog/)?@?([^/?# ]*)"
MAIL_DOMAIN = r"(?s)^[^@]*@(.+)\z"
# Punctuation other than _ and #. The look-behind lets a match start only where a
# run of punctuation starts, so a long run is scanned once.
_EDGE = r"[^\P{P}_#]"
EDGES = rf"^{_EDGE}+|(?<!{_EDGE}){_EDGE}+\z"


def trim_space(c: Col) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(col(c), F.lit(fixed.SPACE_CHARS))


def collapse_space(c: Col) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.btrim(F.regexp_replace(col(c), fixed.SPACE_CLASS + "+", " "))


def clean_token(c: Col) -> Column:
    return F.regexp_replace(trim_space(c), EDGES, "")


def has_asset_suffix(c: Col) -> Column:
    c = col(c)
    hit = F.lit(False)
    for suffix in fixed.ASSET_SUFFIXES:
        hit = hit | c.endswith(suffix)
    return hit


def is_noise(c: Col, terms=fixed.NOISE_TERMS) -> Column:
    low = F.lower(col(c))
    hit = F.lit(False)
    for term in terms:
        hit = hit | low.contains(term)
    return hit


def _guarded(c: Column, needles: tuple[str, ...], found: Column, low: Column | None = None) -> Column:
    """Run the costly pattern only on text that holds one of its fixed parts."""
    low = F.lower(c) if low is None else low
    hit = low.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | low.contains(needle)
    return F.when(hit, found).otherwise(empty_list())


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def emails(c: Col, low: Column | None = None) -> Column:
    c = col(c)
    found = F.transform(_all(c, fixed.EMAIL, 1), lambda v: F.lower(clean_token(v)))
    kept = F.filter(found, lambda v: (v != "") & ~has_asset_suffix(v) & ~v.contains("base64"))
    return _guarded(c, ("@",), F.array_distinct(kept), low)


def telegram_handles(c: Col, low: Column | None = None) -> Column:
    c = col(c)
    picked = F.zip_with(_all(c, fixed.TELEGRAM, 1), _all(c, fixed.TELEGRAM, 2), lambda a, b: F.lower(F.when(a != "", a).otherwise(b)))
    kept = F.filter(picked, lambda v: (v != "") & ~v.isin(*fixed.TELEGRAM_SYSTEM))
    return _guarded(c, ("@", "t.me/", "telegram.me/"), F.array_distinct(kept), low)


def twitter_handles(c: Col, noise=fixed.NOISE_TERMS, low: Column | None = None) -> Column:
    c = col(c)
    found = F.transform(_all(c, fixed.TWITTER, 1), F.lower)
    kept = F.filter(found, lambda v: ~v.isin(*fixed.TWITTER_SYSTEM) & ~is_noise(v, noise))
    return _guarded(c, ("x.com/", "twitter.com/"), F.array_distinct(kept), low)


def linkedin_links(c: Col, noise=fixed.NOISE_TERMS, low: Column | None = None) -> Column:
    c = col(c)
    found = F.filter(F.transform(_all(c, fixed.LINKEDIN, 0), clean_token), lambda v: ~is_noise(v, noise))
    return _guarded(c, ("linkedin.com/",), ordered_unique(found), low)


def skype_ids(c: Col, low: Column | None = None) -> Column:
    c = col(c)
    return _guarded(c, ("skype:", "live:"), ordered_unique(F.transform(_all(c, fixed.SKYPE, 0), clean_token)), low)


def discord_names(c: Col, low: Column | None = None) -> Column:
    c = col(c)
    invites = _guarded(c, ("discord",), F.transform(_all(c, fixed.DISCORD_INVITE, 0), clean_token), low)
    tags = F.transform(_all(c, fixed.DISCORD_TAG, 1), lambda v: F.lower(clean_token(v)))
    return ordered_unique(F.concat(invites, F.when(c.rlike("#[0-9]{4}"), tags).otherwise(empty_list())))


CONTACT_KINDS = ("emails", "skype", "discord", "linkedin", "twitter", "telegram")


def extract_contacts(c: Col, low: Col | None = None) -> Column:
    """All six contact lists of one text as a struct; ``low`` is the lowered text where it is at hand."""
    low = F.lower(col(c)) if low is None else col(low)
    return F.struct(
        emails(c, low).alias("emails"), skype_ids(c, low).alias("skype"), discord_names(c, low).alias("discord"),
        linkedin_links(c, low=low).alias("linkedin"), twitter_handles(c, low=low).alias("twitter"), telegram_handles(c, low).alias("telegram"),
    )


def normalize_handle(c: Col) -> Column:
    """Bare lower-case handle out of a link, an @name or a plain name."""
    return trim_space(F.regexp_extract(trim_space(F.lower(col(c))), HANDLE_SHAPE, 1))


def mail_domain(c: Col) -> Column:
    return F.lower(F.regexp_extract(trim_space(c), MAIL_DOMAIN, 1))


def join_list(values: Col, separator: str = ",") -> Column:
    return F.array_join(col(values), separator)


def split_list(c: Col) -> Column:
    """Comma list to array: trimmed, blanks dropped, order kept; blank text gives NULL."""
    c = col(c)
    parts = F.filter(F.transform(F.split(c, ","), trim_space), lambda v: v != "")
    return F.when(trim_space(c) != "", parts)


def status_text(results: Col, empty: str = "") -> Column:
    """``@user:[STATUS]`` items joined by a comma and a blank; ``empty`` for no result."""
    results = col(results)
    items = F.transform(results, lambda r: F.concat(F.lit("@"), r["username"], F.lit(":["), r["status"], F.lit("]")))
    return F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, F.lit(empty)).otherwise(F.array_join(items, ", "))


def parse_statuses(c: Col) -> Column:
    """Status text back to ``array<struct<username, status>>``; malformed items are dropped."""
    shape = r"(?s)^@?(.*?):\[(.*?)\]?\z"
    items = F.filter(F.transform(F.split(col(c), ","), trim_space), lambda v: v.rlike(shape))
    return F.transform(
        items,
        lambda v: F.struct(F.regexp_extract(v, shape, 1).alias("username"), F.regexp_extract(v, shape, 2).alias("status")),
    )


def parse_time(c: Col) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` (read as UTC) or RFC 3339; anything else is NULL."""
    c = col(c)
    plain = c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?\z")
    zoned = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})\z")
    return F.when(plain, F.concat(c, F.lit("Z"))).when(zoned, c).try_cast("timestamp")


def utc_text(c: Col, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp as UTC text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(col(c), F.current_timezone()), form)


def as_utc(c: Col) -> Column:
    """Timestamp without zone read as UTC."""
    return F.from_utc_timestamp(col(c).cast("timestamp"), F.current_timezone())


def status_class(results: Col) -> Column:
    """'valid' or 'invalid' by the first result only, NULL for none."""
    first = F.get(col(results), F.lit(0))
    return F.when(first.isNull(), F.lit(None).cast("string")).when(first["status"] == "VALID", "valid").otherwise("invalid")

