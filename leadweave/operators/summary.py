"""Run summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.lists import Col, col
from leadweave.operators.lookups import check_handles

_COUNTERS = ("targets", "leads", "flagged", "unflagged", "handles_extracted", "handles_checked",
             "valid", "not_found", "invalid", "skipped", "deleted")


def _percent(part: str) -> Column:
    total = F.col("flagged") + F.col("unflagged")
    return F.when(total > 0, F.round(F.col(part) * 100.0 / total, 1)).otherwise(F.lit(0.0))


def status_counts(status: Col) -> list[Column]:
    """Counters per verdict; FLOOD_WAIT has none."""
    status = col(status)
    return [F.count_if(status == value).alias(value.lower()) for value in ("VALID", "NOT_FOUND", "INVALID", "SKIPPED", "DELETED")]


def _results_with(status: str) -> Column:
    return F.coalesce(F.sum(F.size(F.filter("tg_results", lambda r: r["status"] == status))), F.lit(0))


def run_summary(targets: DataFrame, leads: DataFrame) -> DataFrame:
    """One row of counters and percentages. Targets are counted before any dedup.

    ``leads`` has ``is_cis`` and may have ``tg_results``. Both sides are aggregated to one row of counters and added up.
    """
    zero = F.lit(0).cast("bigint")
    counts = {"leads": F.count("*"), "flagged": F.count_if("is_cis"), "unflagged": F.count_if(~F.col("is_cis"))}
    if "tg_results" in leads.columns:
        handles = F.coalesce(F.sum(F.size("tg_results")), F.lit(0))
        counts |= {"handles_extracted": handles, "handles_checked": handles}
        counts |= {s.lower(): _results_with(s) for s in ("VALID", "NOT_FOUND", "INVALID", "SKIPPED", "DELETED")}
    of_targets = targets.agg(*[(F.count("*") if c == "targets" else F.first(zero)).alias(c) for c in _COUNTERS])
    of_leads = leads.agg(*[counts.get(c, F.first(zero)).cast("bigint").alias(c) for c in _COUNTERS])
    both = of_targets.unionByName(of_leads).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in _COUNTERS])
    return both.withColumn("flagged_pct", _percent("flagged")).withColumn("unflagged_pct", _percent("unflagged"))


def verdict_counts(results: DataFrame, tg_results: Col = "tg_results") -> DataFrame:
    """Extracted, checked and per-status counts over all occurrences of handles."""
    rows = results.select(F.explode(col(tg_results)).alias("r"))
    return rows.agg(F.count("*").alias("extracted"), F.count("*").alias("checked"), *status_counts("r.status"))


def column_widths(flat: DataFrame) -> DataFrame:
    """Display width per column of a flat export: longest text or title, held to 12-60, plus 2."""
    widths = [F.struct(F.lit(i).alias("pos"), F.lit(title).alias("title"),
                       (F.least(F.lit(60), F.greatest(F.lit(12), F.lit(len(title)), F.coalesce(F.max(F.length(F.col(f"`{title}`"))), F.lit(0)))) + 2).alias("width"))
              for i, title in enumerate(flat.columns)]
    return flat.agg(F.array(*widths).alias("w")).select(F.inline("w"))


def handle_report(targets: DataFrame, snapshot: DataFrame | None, handle: str, order: list[str]) -> DataFrame:
    """One row per listed handle, duplicates kept, in any spelling."""
    checked = check_handles(targets, snapshot, handle)
    return checked.select(*order, *[F.col("verdict").getField(f).alias(f) for f in ("username", "status", "user_id", "is_bot", "was_verified", "is_deleted")])


