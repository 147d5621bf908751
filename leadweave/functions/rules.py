"""First-match lead rules with a reason text.

Rule sets are always passed in by the caller; none is applied by default. The name rules guess at a
person's background from the spelling of a name, misfire often, and need a deliberate choice by whoever
runs them; the mail rules look at mail hosts only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.lists import Col, col, let, literals
from leadweave.functions.text import trim_space


@dataclass(frozen=True)
class MailRules:
    tlds: tuple[str, ...] = fixed.MAIL_TLDS
    providers: tuple[str, ...] = fixed.MAIL_PROVIDERS


@dataclass(frozen=True)
class NameRules:
    tokens: tuple[str, ...] = fixed.NAME_TOKENS
    suffix: str = fixed.NAME_SUFFIX
    ignored_words: tuple[str, ...] = fixed.IGNORED_WORDS
    system_local_parts: tuple[str, ...] = fixed.SYSTEM_LOCAL_PARTS


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def _tagged(prefix: str, reason: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), reason, F.lit(suffix))


def name_reason(c: Col, names: NameRules) -> Column:
    """Why a name matches, or NULL: first listed token it holds, else its first word with a listed suffix."""

    def check(v: Column) -> Column:
        token = _first(literals(names.tokens), lambda t: F.contains(v, t))
        word = _first(F.split(v, "[ ._@-]+"), lambda w: ~F.array_contains(literals(names.ignored_words), w) & w.rlike(names.suffix))
        return F.coalesce(
            _tagged("Slavic name token [", token, "]"),
            _tagged("Slavic surname suffix in [", word, "]"),
        )

    return let(F.lower(trim_space(c)), check)


def mail_reason(c: Col, mail: MailRules | None, names: NameRules | None = None) -> Column:
    """Why one e-mail matches, or NULL. System mailboxes skip the name rule only."""

    def check(v: Column) -> Column:
        domain = F.regexp_extract(v, r"(?s)^[^@]*@(.*)\z", 1)
        local = F.regexp_extract(v, r"^([^@]*)@", 1)
        reasons = []
        if mail is not None:
            reasons.append(_tagged("Email CIS TLD match: ", _first(literals(mail.tlds), lambda t: F.endswith(domain, t))))
            reasons.append(_tagged("CIS mail provider match: ", _first(literals(mail.providers), lambda t: F.contains(domain, t))))
        if names is not None:
            checked = F.when(~F.array_contains(literals(names.system_local_parts), local), name_reason(local, names))
            reasons.append(_tagged("Email prefix match: ", checked))
        return F.when(v.contains("@"), F.coalesce(*reasons))

    return let(F.lower(trim_space(c)), check)


def rule_reason(raw_name: Col, company: Col, emails: Col, handles: Col,
                mail: MailRules | None, names: NameRules | None) -> Column:
    """First matching reason over name, company, each e-mail, each handle; NULL for none."""
    if mail is None and names is None:
        raise ValueError("pass mail rules, name rules or both")
    steps = []
    if names is not None:
        steps += [_tagged("Name match: ", name_reason(raw_name, names)), _tagged("Company match: ", name_reason(company, names))]
    steps.append(_first(F.transform(col(emails), lambda e: mail_reason(e, mail, names)), lambda r: r.isNotNull()))
    if names is not None:
        hit = F.transform(col(handles), lambda h: _tagged("Telegram handle match: ", name_reason(h, names)))
        steps.append(_first(hit, lambda r: r.isNotNull()))
    return F.coalesce(*steps)


def classify(leads: DataFrame, mail: MailRules | None, names: NameRules | None,
             raw_name: Col = "raw_name", company: Col = "company_name",
             emails: Col = "contacts.emails", handles: Col = "contacts.telegram") -> DataFrame:
    """Add ``is_cis`` and ``cis_reason`` (empty for no match)."""
    reason = F.coalesce(rule_reason(raw_name, company, emails, handles, mail, names), F.lit(""))
    return leads.withColumn("cis_reason", reason).withColumn("is_cis", F.col("cis_reason") != "")
