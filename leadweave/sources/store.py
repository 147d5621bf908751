"""The stored leads table: write log, upsert fold, scans.

Writes are appended, one folder per writer and batch, and folded when read. A replayed batch overwrites its own folder, so a
lost executor or a restarted stream leaves the table as it should be, and no job overwrites what it reads. ``compact`` folds the
log into a state that later writes are folded onto.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.functions.text import join_list, parse_statuses, split_list, status_text
from leadweave.functions.urls import source_domain
from leadweave.sources.versioned import VersionedTable

LOG_ROWS = 250_000  # rows of one file of the write log: a task that folds it sorts whole files
LISTS = ("emails", "telegram_handles", "skype", "linkedin", "twitter")
TEXTS = ("company_name", "emails", "telegram_handles", "tg_validation_status", "skype", "linkedin", "twitter", "cis_reason")
FLAGS = ("is_cis", "mx_valid")

STORED = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("company_name", T.StringType(), False),
    T.StructField("source_url", T.StringType(), False), T.StructField("source_domain", T.StringType(), False),
    *[T.StructField(c, T.StringType()) for c in ("emails", "telegram_handles", "tg_validation_status", "skype", "linkedin", "twitter")],
    T.StructField("is_cis", T.BooleanType()), T.StructField("cis_reason", T.StringType()), T.StructField("mx_valid", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
])

WRITES = T.StructType([T.StructField("seq", T.LongType(), False), *STORED.fields[:-2], T.StructField("written_at", T.TimestampType())])


def stored_rows(leads: DataFrame, seq: Column, written_at: Column | None = None) -> DataFrame:
    """Nested leads as rows of the write log (lists joined by a comma; Discord and network data are not stored)."""
    contact = {"emails": "emails", "telegram_handles": "telegram", "skype": "skype", "linkedin": "linkedin", "twitter": "twitter"}
    values = {
        "seq": seq.cast("bigint"), "id": F.col("id"), "company_name": F.col("company_name"), "source_url": F.col("source_url"),
        "source_domain": source_domain("source_url"), "tg_validation_status": status_text("tg_results"),
        "is_cis": F.col("is_cis"), "cis_reason": F.col("cis_reason"), "mx_valid": F.col("mx_valid"),
        "written_at": F.current_timestamp() if written_at is None else written_at,
        **{name: join_list(f"contacts.{part}") for name, part in contact.items()},
    }
    return leads.select(*[values[f.name].alias(f.name) for f in WRITES.fields])


def fold_state(writes: DataFrame, key: str = "source_url", seq: str = "seq", written_at: str = "written_at") -> DataFrame:
    """What any number of writes say about each key, in a form that can be folded on: with other states, or with itself.

    ``first`` and ``last`` are the first and latest write, ``text_<name>`` the latest non-empty text, each with its order. Writes of one
    ``seq`` are ordered by a hash of their whole content, so the order of rows does not matter. Partial results are folded before
    the shuffle: a URL written over and over costs no more than any other.
    """
    have = writes.columns
    writes = writes.withColumn("at", F.struct(F.col(seq).alias("seq"), F.xxhash64(*sorted(have)).alias("tie")))  # once, below the aggregate
    order = F.col("at")
    first = F.struct(order, "id", *[c for c in ("source_domain",) if c in have], F.col(written_at).alias("time"))
    last = F.struct(order, *[c for c in FLAGS if c in have], F.col(written_at).alias("time"))
    texts = [F.max(F.when(F.col(c) != "", F.struct(order, F.col(c).alias("value")))).alias(f"text_{c}") for c in TEXTS if c in have]
    return writes.groupBy(key).agg(F.min(first).alias("first"), F.max(last).alias("last"), *texts)


def merge_states(states: DataFrame, key: str = "source_url") -> DataFrame:
    """One state per key out of several."""
    return states.groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.max(c).alias(c) for c in states.columns if c.startswith("text_")])


def folded(state: DataFrame, key: str = "source_url") -> DataFrame:
    """The rows that states stand for: ``id`` and ``created_at`` of the first write, texts latest non-empty, flags and ``updated_at`` latest."""
    first, last = state.schema["first"].dataType.names, state.schema["last"].dataType.names
    return state.select(
        key, F.col("first.id").alias("id"), *[F.col(f"first.{c}").alias(c) for c in ("source_domain",) if c in first],
        *[F.coalesce(F.col(f"text_{c}.value"), F.lit("")).alias(c) for c in TEXTS if f"text_{c}" in state.columns], *[F.col(f"last.{c}").alias(c) for c in FLAGS if c in last],
        F.col("first.time").alias("created_at"), F.col("last.time").alias("updated_at"), F.col("last.at.seq").alias("seq"))


def upsert_fold(writes: DataFrame, key: str = "source_url", seq: str = "seq", written_at: str = "written_at") -> DataFrame:
    """One row per key out of any number of writes."""
    return folded(fold_state(writes, key, seq, written_at), key)


def append_writes(rows: DataFrame, path: str, writer: str, batch_id: int) -> None:
    """Add one batch of a writer to the write log; the same batch written again replaces itself, other writers' batches stay.

    Files are bounded in rows, so what a reading task holds depends on the session's split size and not on the size of a batch.
    """
    rows.write.mode("overwrite").option("maxRecordsPerFile", LOG_ROWS).parquet(f"{path}/writer={writer}/batch_id={batch_id}")


def read_writes(spark: SparkSession, path: str, schema: T.StructType = WRITES) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/writer=*/batch_id=*")


def compact(spark: SparkSession, path: str, into: str, schema: T.StructType = WRITES, onto: DataFrame | None = None) -> DataFrame:
    """Fold the write log, onto an earlier state if given, and write the state to a new folder ``into``. Its batches can be removed then.

    Later reads fold only newer batches onto it: ``folded(merge_states(state.unionByName(fold_state(newer))))``.
    """
    state = fold_state(read_writes(spark, path, schema))
    state = state if onto is None else merge_states(state.unionByName(onto))
    state.write.parquet(into)
    return spark.read.schema(state.schema).parquet(into)


def lead_table(spark: SparkSession, path: str, key: str = "source_url", buckets: int = 64) -> VersionedTable:
    """The stored leads as a table that is read while it is written: commit ``fold_state`` of a batch, read with ``folded``."""
    return VersionedTable(spark, path, key, lambda states: merge_states(states, key), buckets)


def id_clashes(stored: DataFrame) -> DataFrame:
    """Ids that stand for more than one URL, against the table's key: ``id, n_urls``."""
    return stored.groupBy("id").agg(F.count_distinct("source_url").alias("n_urls")).filter("n_urls > 1")


def publish(current: DataFrame, path: str) -> None:
    """Write the folded table split by flag and sorted by domain, so that both predicates prune on read.

    Ranges go down to the URL: a domain that holds a third of all leads is cut over several files.
    """
    order = ("is_cis", "source_domain", "source_url")
    sorted_rows = current.repartitionByRange(*order).sortWithinPartitions(*order)
    # a Bloom filter of the URLs, so that single ones skip row groups
    sorted_rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#source_url", "true").partitionBy("is_cis").parquet(path)


def read_published(spark: SparkSession, path: str, schema: T.StructType = STORED) -> DataFrame:
    """The published table; the schema is given, as a flag in a folder name would be read as text."""
    return spark.read.schema(schema).parquet(path)


def publish_ordered(current: DataFrame, path: str, files: int | None = None) -> None:
    """Write the folded table by ranges of (``created_at``, ``id``), each range a sorted file, and next to it the borders of the files.

    As many files as given, else as Spark finds fit.
    """
    order = ("created_at", "id")
    current.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/rows")
    written = current.sparkSession.read.schema(current.schema).parquet(f"{path}/rows")
    borders = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("n"))
    borders.coalesce(1).write.mode("overwrite").parquet(f"{path}/borders")


def scan_page(spark: SparkSession, path: str, limit: int, after: tuple | None = None, schema: T.StructType = STORED) -> DataFrame:
    """The next ``limit`` leads after the key ``(created_at, id)`` in the table's order; from the start without a key.

    The borders, one row a file, tell which files hold them, so a page reads the file it begins in and as many as it reaches into.
    """
    key = F.struct("created_at", "id")
    files = spark.read.parquet(f"{path}/borders")
    rows = None
    if after is not None:
        limit_key = F.struct(F.lit(after[0]).cast("timestamp").alias("created_at"), F.lit(after[1]).alias("id"))
        files, rows = files.filter(F.col("last") > limit_key), key > limit_key
    names, held = [], 0
    for border in files.orderBy("first").select("file", "n").toLocalIterator():
        if held >= limit:
            break
        held += border.n if names or after is None else 0  # the page may begin at the first file's end
        names.append(border.file)
    found = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return (found if rows is None else found.filter(rows)).orderBy("created_at", "id").limit(limit)


def scan_leads(stored: DataFrame, flagged_only: bool = False, ordered: bool = True) -> DataFrame:
    """Stored rows as leads: lists split back, optional flag predicate, ordered by ``created_at, id``."""
    rows = stored.filter("is_cis") if flagged_only else stored
    for name in LISTS:
        if name in rows.columns:
            rows = rows.withColumn(name, split_list(name))
    rows = rows.withColumn("raw_name", F.col("company_name"))
    if "tg_validation_status" in rows.columns:
        rows = rows.withColumn("tg_results", parse_statuses("tg_validation_status"))
    return rows.orderBy("created_at", "id") if ordered else rows


def known_urls(stored: DataFrame) -> DataFrame:
    return stored.select("source_url").distinct()
