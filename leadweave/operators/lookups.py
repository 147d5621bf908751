"""Handle and mail-domain lookups against snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed
from leadweave.functions.lists import Col, col
from leadweave.functions.text import mail_domain, normalize_handle

VERDICT_FIELDS = ("username", "status", "user_id", "is_bot", "is_deleted", "was_verified", "error_reason")


def error_verdict(error: Col) -> tuple[Column, Column]:
    """Status and reason for a lookup error text."""
    error = col(error)
    missing = error.contains("USERNAME_NOT_OCCUPIED")
    return (F.when(missing, "NOT_FOUND").otherwise("INVALID"),
            F.when(missing, fixed.NOT_OCCUPIED_TEXT).otherwise(error))


def verdict(username: Col, found: dict[str, Column] | None) -> Column:
    """Verdict of one handle as a struct; ``found`` holds the snapshot columns, None where there is no snapshot."""
    username = col(username)
    if found is None:
        parts = (username, F.lit("SKIPPED"), F.lit(0).cast("bigint"), F.lit(False), F.lit(False), F.lit(False), F.lit(fixed.NO_LOOKUP_TEXT))
        return F.struct(*[p.alias(n) for p, n in zip(parts, VERDICT_FIELDS)])
    error = F.coalesce(found["error_code"], F.lit(""))
    failed_status, failed_text = error_verdict(error)
    blank, failed = username == "", error != ""
    absent = found["user_id"].isNull()
    deleted = F.coalesce(found["is_deleted"], F.lit(False))
    status = (F.when(blank, "INVALID").when(failed, failed_status).when(absent, "NOT_FOUND")
              .when(deleted, "DELETED").otherwise("VALID"))
    reason = (F.when(blank, fixed.EMPTY_HANDLE_TEXT).when(failed, failed_text).when(absent, "")
              .when(deleted, fixed.DELETED_TEXT).otherwise(""))
    known = ~(blank | failed | absent)
    flags = [F.when(known, F.coalesce(found[c], F.lit(False))).otherwise(False) for c in ("is_bot", "is_deleted", "was_verified")]
    user_id = F.when(known, found["user_id"].cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return F.struct(*[p.alias(n) for p, n in zip((username, status, user_id, *flags, reason), VERDICT_FIELDS)])


def check_handles(handles: DataFrame, snapshot: DataFrame | None, handle: str) -> DataFrame:
    """Add ``verdict`` to rows that carry a handle in any spelling.

    A snapshot may have ``lookup_error``, why a handle could not be looked up at all; it comes out as a column of that name.
    Of a handle listed more than once the greatest entry holds, by account, flags and error in that order, so a found
    account wins over a missing one. A plain left join: Spark splits the tasks of a handle that very many rows carry.
    """
    named = handles.withColumn("__handle", normalize_handle(handle))
    if snapshot is None:
        return named.withColumn("verdict", verdict("__handle", None)).withColumn("lookup_error", F.lit(None).cast("string")).drop("__handle")
    names = ("user_id", "is_bot", "is_deleted", "was_verified", "error_code")
    # the greatest entry holds; an entry that was looked up is greater than one that was not
    asked = snapshot if "lookup_error" in snapshot.columns else snapshot.withColumn("lookup_error", F.lit(None).cast("string"))
    best = F.max(F.struct(F.col("lookup_error").isNull().alias("done"), *names, "lookup_error")).alias("__found")
    table = asked.groupBy(F.col("handle").alias("__handle")).agg(best)
    joined = named.join(table, "__handle", "left")
    return joined.withColumn("verdict", verdict("__handle", {n: F.col("__found").getField(n) for n in names})).withColumn("lookup_error", F.col("__found.lookup_error")).drop("__found", "__handle")


def handle_results(leads: DataFrame, snapshot: DataFrame | None, key: str = "id", handles: Col = "contacts.telegram") -> DataFrame:
    """``key, tg_results, usable, lookup_error``: all verdicts of a lead in handle order, the handles that stay usable, and the first handle
    that could not be looked up, with the reason."""
    rows = leads.select(key, F.posexplode(col(handles)).alias("pos", "handle"))
    checked = check_handles(rows, snapshot, "handle")
    each = F.sort_array(F.collect_list(F.struct("pos", "handle", "verdict", "lookup_error")))
    return checked.groupBy(key).agg(each.alias("each")).select(
        key,
        F.transform("each", lambda e: e["verdict"]).alias("tg_results"),
        F.transform(F.filter("each", lambda e: e["verdict"]["status"].isin(*fixed.USABLE_STATUSES)), lambda e: e["handle"]).alias("usable"),
        F.get(F.transform(F.filter("each", lambda e: e["lookup_error"].isNotNull()), lambda e: F.concat(F.lit('handle "'), e["handle"], F.lit('": '), e["lookup_error"])), F.lit(0)).alias("lookup_error"),
    )


def verify_handles(leads: DataFrame, snapshot: DataFrame | None = None, key: str = "id", checked_at: Column | None = None) -> DataFrame:
    """Add ``tg_results``, each with its time ``checked_at`` (now, if not given), and keep only usable handles in ``contacts.telegram``.

    ``lookup_error`` says which handle could not be looked up, if the snapshot tells. ``leads`` is read twice, for the handles and for the rows they go back to: pass a stored table, not a costly plan.
    """
    now = F.current_timestamp() if checked_at is None else checked_at
    if snapshot is None:  # every handle is SKIPPED and stays: no join, no shuffle
        skipped = F.transform("contacts.telegram", lambda h: verdict(normalize_handle(h), None))
        return leads.withColumn("tg_results", F.transform(skipped, lambda r: r.withField("checked_at", now))).withColumn("lookup_error", F.lit(None).cast("string"))
    results = handle_results(leads, snapshot, key).withColumn("tg_results", F.transform("tg_results", lambda r: r.withField("checked_at", now)))
    none = F.array().cast(results.schema["tg_results"].dataType)
    kept = F.coalesce("usable", F.array().cast("array<string>"))
    return (leads.join(results, key, "left")
            .withColumn("tg_results", F.coalesce("tg_results", none))
            .withColumn("contacts", F.col("contacts").withField("telegram", kept)).drop("usable"))


def check_domains(rows: DataFrame, mx_snapshot: DataFrame, email: str) -> DataFrame:
    """Add ``mx_ok``: a timed-out lookup passes, a failed or missing one does not; no domain is no pass. Of a domain listed
    more than once, one passing entry is enough."""
    named = rows.withColumn("domain", mail_domain(email))
    passes = F.coalesce(F.col("outcome") == "timeout", F.lit(False)) | (F.coalesce("n_mx", F.lit(0)) > 0)
    joined = named.join(mx_snapshot.groupBy("domain").agg(F.bool_or(passes).alias("__ok")), "domain", "left")
    return joined.withColumn("mx_ok", (F.col("domain") != "") & F.coalesce("__ok", F.lit(False))).drop("__ok")


def lead_mx(leads: DataFrame, mx_snapshot: DataFrame, key: str = "id", emails: Col = "contacts.emails") -> DataFrame:
    """``key, mx_valid`` for leads with at least one e-mail: true when any of its domains passes."""
    rows = leads.select(key, F.posexplode(col(emails)).alias("pos", "email"))
    return check_domains(rows, mx_snapshot, "email").groupBy(key).agg(F.bool_or("mx_ok").alias("mx_valid"))


def verify_domains(leads: DataFrame, mx_snapshot: DataFrame | None, key: str = "id") -> DataFrame:
    """Add ``mx_valid``; false without e-mails or without a snapshot. Reads ``leads`` twice, as :func:`verify_handles` does."""
    if mx_snapshot is None:
        return leads.withColumn("mx_valid", F.lit(False))
    return leads.join(lead_mx(leads, mx_snapshot, key), key, "left").withColumn("mx_valid", F.coalesce("mx_valid", F.lit(False)))
