"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from leadweave import fixed

WS = "'" + fixed.SPACE_CHARS + "'"
CLASS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EMAIL = fixed.EMAIL.removesuffix("++)") + "+)"
PATTERNS = {
    "emails": (EMAIL, 1), "twitter": (fixed.TWITTER, 1), "linkedin": (fixed.LINKEDIN, 0), "skype": (fixed.SKYPE, 0),
    "invites": (fixed.DISCORD_INVITE, 0), "tags": (fixed.DISCORD_TAG, 1),
}


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '^[^\P{{P}}_#]+|[^\P{{P}}_#]+\z', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{CLASS}+', ' ', 'g'))"


def noise(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{t}')" for t in fixed.NOISE_TERMS) + ")"


def any_suffix(x: str) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in fixed.ASSET_SUFFIXES) + ")"


def values(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def string_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def _matches(pattern: str, group: int, src: str, keys: str) -> str:
    return (f"SELECT {keys}, unnest(regexp_extract_all(raw, '{pattern}', {group})) AS m, "
            f"generate_subscripts(regexp_extract_all(raw, '{pattern}', {group}), 1) AS i FROM {src}")


def contact_candidates(kind: str, src: str, keys: str) -> str:
    """Rows (keys, i, v) of one contact kind in match order, not yet unique; ``src`` has ``raw``."""
    if kind == "emails":
        inner = f"SELECT {keys}, i, lower({clean('m')}) AS v FROM ({_matches(*PATTERNS['emails'], src, keys)})"
        return f"SELECT * FROM ({inner}) WHERE v <> '' AND NOT {any_suffix('v')} AND NOT contains(v, 'base64')"
    if kind == "telegram":
        p = fixed.TELEGRAM
        inner = (f"SELECT {keys}, i, lower(coalesce(nullif(a, ''), b)) AS v FROM (SELECT {keys}, unnest(regexp_extract_all(raw, '{p}', 1)) AS a, "
                 f"unnest(regexp_extract_all(raw, '{p}', 2)) AS b, generate_subscripts(regexp_extract_all(raw, '{p}', 0), 1) AS i FROM {src})")
        return f"SELECT * FROM ({inner}) WHERE v <> '' AND v NOT IN {values(fixed.TELEGRAM_SYSTEM)}"
    if kind == "twitter":
        inner = f"SELECT {keys}, i, lower(m) AS v FROM ({_matches(*PATTERNS['twitter'], src, keys)})"
        return f"SELECT * FROM ({inner}) WHERE v NOT IN {values(fixed.TWITTER_SYSTEM)} AND NOT {noise('v')}"
    if kind == "linkedin":
        return f"SELECT * FROM (SELECT {keys}, i, {clean('m')} AS v FROM ({_matches(*PATTERNS['linkedin'], src, keys)})) WHERE NOT {noise('v')}"
    if kind == "skype":
        return f"SELECT {keys}, i, {clean('m')} AS v FROM ({_matches(*PATTERNS['skype'], src, keys)})"
    if kind == "discord":
        return (f"SELECT {keys}, i, {clean('m')} AS v FROM ({_matches(*PATTERNS['invites'], src, keys)}) UNION ALL "
                f"SELECT {keys}, 1000000000 + i, lower({clean('m')}) AS v FROM ({_matches(*PATTERNS['tags'], src, keys)})")
    raise KeyError(kind)


def unique(candidates: str, keys: str) -> str:
    """First spelling of every value ignoring case: (keys, pos, value), pos from 0."""
    return (f"SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS pos, value FROM ("
            f"SELECT {keys}, min(i) AS i, arg_min(v, i) AS value FROM ({candidates}) WHERE {trim('v')} <> '' GROUP BY {keys}, lower(v))")


def contacts(kind: str, src: str, keys: str) -> str:
    return unique(contact_candidates(kind, src, keys), keys)


KINDS = ("emails", "skype", "discord", "linkedin", "twitter", "telegram")


def contacts_long(src: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{k}' AS kind, pos, value FROM ({contacts(k, src, keys)})" for k in KINDS)


def decode(x: str, markup: bool = True) -> str:
    """References that occur in the test pages; with ``markup`` also those of & < > quotes, & last."""
    for ref, text in (("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{ref}', '{text}')"
    if markup:
        for ref, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
            x = f"replace({x}, '{ref}', '{text}')"
    return x


HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host(url: str) -> str:
    h = f"lower(regexp_extract({url}, '{HOST}', 1))"
    return f"CASE WHEN regexp_matches({h}, '{CLASS}') THEN '' ELSE {h} END"


def route_host(url: str) -> str:
    return rf"regexp_replace({host(trim(url))}, '\.\z', '')"


def name_reason(x: str) -> str:
    v = f"lower({trim(x)})"
    token = f"list_filter({string_list(fixed.NAME_TOKENS)}, lambda t: contains({v}, t))[1]"
    word = (f"list_filter(regexp_split_to_array({v}, '[ ._@-]+'), lambda w: NOT list_contains({string_list(fixed.IGNORED_WORDS)}, w) "
            f"AND regexp_matches(w, '{fixed.NAME_SUFFIX}'))[1]")
    return f"coalesce('Slavic name token [' || {token} || ']', 'Slavic surname suffix in [' || {word} || ']')"


def mail_reason(x: str, names: bool) -> str:
    v = f"lower({trim(x)})"
    dom, local = rf"regexp_extract({v}, '(?s)^[^@]*@(.*)\z', 1)", f"regexp_extract({v}, '^([^@]*)@', 1)"
    tld = f"'Email CIS TLD match: ' || list_filter({string_list(fixed.MAIL_TLDS)}, lambda t: ends_with({dom}, t))[1]"
    provider = f"'CIS mail provider match: ' || list_filter({string_list(fixed.MAIL_PROVIDERS)}, lambda t: contains({dom}, t))[1]"
    parts = [tld, provider]
    if names:
        parts.append(f"CASE WHEN {local} NOT IN {values(fixed.SYSTEM_LOCAL_PARTS)} THEN 'Email prefix match: ' || {name_reason(local)} END")
    return f"CASE WHEN contains({v}, '@') THEN coalesce({', '.join(parts)}) END"


def normalize_handle(x: str) -> str:
    v = f"lower({x})"
    v = trim(v)
    for prefix in ("https://", "http://", r"www\.", r"t\.me/", r"telegram\.me/", r"telegram\.dog/", "@"):
        v = f"regexp_replace({v}, '^{prefix}', '')"
    return trim(f"regexp_extract({v}, '^[^/?# ]*')")


def verdict(handle: str) -> dict[str, str]:
    """Verdict columns for a join with handle_snapshot s."""
    err = "coalesce(s.error_code, '')"
    known = f"({handle} <> '' AND {err} = '' AND s.user_id IS NOT NULL)"
    status = (f"CASE WHEN {handle} = '' THEN 'INVALID' WHEN contains({err}, 'USERNAME_NOT_OCCUPIED') THEN 'NOT_FOUND' WHEN {err} <> '' THEN 'INVALID' "
              f"WHEN s.user_id IS NULL THEN 'NOT_FOUND' WHEN s.is_deleted THEN 'DELETED' ELSE 'VALID' END")
    reason = (f"CASE WHEN {handle} = '' THEN '{fixed.EMPTY_HANDLE_TEXT}' WHEN contains({err}, 'USERNAME_NOT_OCCUPIED') THEN '{fixed.NOT_OCCUPIED_TEXT}' "
              f"WHEN {err} <> '' THEN {err} WHEN s.user_id IS NULL THEN '' WHEN s.is_deleted THEN '{fixed.DELETED_TEXT}' ELSE '' END")
    flag = lambda c: f"CASE WHEN {known} THEN s.{c} ELSE false END"
    return {"status": status, "user_id": f"CASE WHEN {known} THEN s.user_id ELSE 0 END", "is_bot": flag("is_bot"),
            "is_deleted": flag("is_deleted"), "was_verified": flag("was_verified"), "error_reason": reason}


def select_verdict(handle: str) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in verdict(handle).items())
