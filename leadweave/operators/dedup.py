"""First-seen dedup with a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.lists import Col, col
from leadweave.functions.text import trim_space


def dedup_key(c: Col) -> Column:
    return F.lower(trim_space(c))


def first_seen(rows: DataFrame, key: Col, order: list[str]) -> DataFrame:
    """One row per lowered, trimmed key: the first by ``order``. Blank keys count as duplicates.

    An aggregate rather than a window: every map task hands on at most one row per key, so a key that
    holds a third of all rows costs no more than any other.
    """
    columns = rows.columns
    ranked = rows.select(dedup_key(key).alias("__key"), F.struct(*order).alias("__order"), F.struct(*columns).alias("__row"))
    kept = ranked.filter(F.col("__key") != "").groupBy("__key").agg(F.min_by("__row", "__order").alias("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def shared_keys(rows: DataFrame, key: Col, owner: Col) -> DataFrame:
    """Report of keys and how many owners carry them (``key``, ``n_owners``)."""
    pairs = rows.select(col(key).alias("key"), col(owner).alias("owner")).distinct()
    return pairs.groupBy("key").agg(F.count("*").alias("n_owners"))
