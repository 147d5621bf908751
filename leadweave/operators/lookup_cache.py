"""Lookup results kept across runs: only keys without a fresh result are asked for.

Results lie in a versioned table by key, each with the time it was looked up. A run reads the buckets of its own keys, asks for those that are missing or too
old, and commits what it learns. What should not be remembered (a lookup that timed out, say) is passed on, but not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.session import write_once
from leadweave.sources.versioned import VersionedTable

WRITER = "lookups"


def result_table(spark: SparkSession, path: str, key: str, buckets: int = 64) -> VersionedTable:
    """A table of ``key, value, checked_at``; of several results of a key the latest holds."""
    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by("value", "checked_at").alias("value"), F.max("checked_at").alias("checked_at"))

    return VersionedTable(spark, path, key, latest, buckets)


def cached_lookup(keys: DataFrame, table: VersionedTable, ask: Callable[[DataFrame], DataFrame], now: Column, max_age: str) -> DataFrame:
    """``key, value, checked_at, asked`` of every distinct key (one column; nulls are none).

    ``ask`` gets the keys without a result of at most ``max_age`` (an interval, such as ``30 days``), one column named as the table's key,
    and returns a row for each: that column, ``value``, and ``keep``, whether the result may be remembered. ``asked`` tells the two apart.
    """
    key = table.key
    wanted = write_once(keys.select(F.col(f"`{keys.columns[0]}`").alias(key)).filter(F.col(key).isNotNull()).distinct(), "wanted-keys")
    known = table.manifest()
    held = table.lookup(wanted).filter(F.col("checked_at") >= now - F.expr(f"INTERVAL {max_age}")) if known.version else None
    missing = wanted if held is None else wanted.join(held, key, "left_anti")
    found = write_once(ask(missing).withColumn("checked_at", now).select(key, "value", "checked_at", "keep"), "looked-up")
    table.commit(found.filter("keep").drop("keep"), WRITER, known.writers.get(WRITER, -1) + 1)
    fresh = found.drop("keep").withColumn("asked", F.lit(True))
    return fresh if held is None else held.select(key, "value", "checked_at").withColumn("asked", F.lit(False)).unionByName(fresh)


def ask_domains(mx_snapshot: DataFrame, key: str = "domain") -> Callable[[DataFrame], DataFrame]:
    """Whether mail domains pass: a timed-out lookup passes and is not remembered, a failed or missing one does not pass and is."""
    timed_out = F.coalesce(F.col("outcome") == "timeout", F.lit(False))
    answers = mx_snapshot.groupBy(F.col("domain").alias(key)).agg(F.bool_or(timed_out | (F.coalesce("n_mx", F.lit(0)) > 0)).alias("ok"), F.bool_and(timed_out).alias("late"))

    def ask(keys: DataFrame) -> DataFrame:
        return keys.join(answers, key, "left").select(key, F.coalesce("ok", F.lit(False)).alias("value"), (~F.coalesce("late", F.lit(False))).alias("keep"))

    return ask
