"""Exports of leads: flat rows, nested rows, and the writer chosen by the path."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.lists import Col, col
from leadweave.functions.text import status_text, utc_text


def flat_columns(contacts: dict[str, Col], results: Col, **plain: Col) -> list[Column]:
    """The 13 titled text columns of the flat export."""
    joined = {name: F.coalesce(F.array_join(col(c), ", "), F.lit("")) for name, c in contacts.items()}
    values = [
        col(plain["id"]), col(plain["company_name"]), col(plain["source_url"]), joined["emails"], joined["telegram"],
        status_text(results, "N/A"), joined["linkedin"], joined["skype"], joined["discord"], joined["twitter"],
        col(plain["is_cis"]).cast("string"), col(plain["cis_reason"]), utc_text(plain["created_at"]),
    ]
    return [v.alias(t) for v, t in zip(values, fixed.EXPORT_TITLES)]


_PLAIN = {c: c for c in ("id", "company_name", "source_url", "is_cis", "cis_reason", "created_at")}


def flatten_leads(leads: DataFrame) -> DataFrame:
    contacts = {c: f"contacts.{c}" for c in ("emails", "telegram", "linkedin", "skype", "discord", "twitter")}
    return leads.select(*flat_columns(contacts, "tg_results", **_PLAIN))


def flatten_stored(leads: DataFrame) -> DataFrame:
    """Flat export of a store scan; Discord names are not stored, so that column is empty."""
    no_list, no_results = F.array().cast("array<string>"), F.array().cast("array<struct<username:string,status:string>>")
    lists = {"emails": "emails", "telegram": "telegram_handles", "linkedin": "linkedin", "skype": "skype", "twitter": "twitter"}
    contacts = {k: (F.col(c) if c in leads.columns else no_list) for k, c in lists.items()} | {"discord": no_list}
    results = F.col("tg_results") if "tg_results" in leads.columns else no_results
    return leads.select(*flat_columns(contacts, results, **_PLAIN))


LEAD_FIELDS = ("id", "source_url", "company_name", "raw_name", "contacts", "network_metadata", "tg_results", "is_cis", "cis_reason", "mx_valid", "created_at", "updated_at")


def _none_if_empty(c: Col) -> Column:
    return F.nullif(col(c), F.lit(""))


def _none_if_no_items(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def nested_leads(leads: DataFrame) -> DataFrame:
    """Leads as the JSON export has them: optional fields that are empty become NULL, which the writer leaves out."""
    out = leads.withColumn("cis_reason", _none_if_empty("cis_reason"))
    if "tg_results" in leads.columns:
        results = F.transform("tg_results", lambda r: r.withField("user_id", F.nullif(r["user_id"], F.lit(0).cast("bigint")))
                              .withField("error_reason", F.nullif(r["error_reason"], F.lit(""))))
        out = out.withColumn("tg_results", _none_if_no_items(results))
    if "network" in leads.columns:
        lists = ("emails", "skype", "telegram")
        managers = F.transform("network.managers", lambda m: F.struct(m["name"].alias("name"), *[_none_if_no_items(m[c]).alias(c) for c in lists]))
        fields = [_none_if_empty(f"network.{c}").alias(c) for c in ("commission_type", "payment_frequency", "minimum_payout", "referral_rate")]
        network = F.struct(*fields, _none_if_no_items(managers).alias("managers"))
        out = out.withColumn("network_metadata", F.when(F.col("network").isNotNull(), network)).drop("network")
    return out.select(*[c for c in LEAD_FIELDS if c in out.columns])


# options to read a CSV export back: quoted empty texts stay empty instead of turning into NULL
CSV_OPTIONS = {"header": True, "escape": '"', "multiLine": True, "nullValue": "\0"}


def write_leads(leads: DataFrame, path: str) -> None:
    """Write leads in the form the path's ending names: .csv (flat), .json (nested, one object per line), .parquet."""
    ending = posixpath.splitext(path.rstrip("/"))[1].lower()
    if ending == ".csv":
        as_written = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        flatten_leads(leads).write.mode("overwrite").options(**as_written).csv(path)
    elif ending == ".json":
        nested_leads(leads).write.mode("overwrite").json(path)
    elif ending == ".parquet":
        leads.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unsupported export format extension: {ending}")
