"""Incremental forms of dedup, upsert and known-URL filtering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadweave.functions.lists import Col
from leadweave.operators.dedup import dedup_key
from leadweave.sources.store import append_writes, fold_state, known_urls
from leadweave.sources.versioned import VersionedTable

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_first_seen(rows: DataFrame, key: Col, event_time: str | None = None, forget_after: str | None = None) -> DataFrame:
    """One row per lowered, trimmed key over the whole life of the stream; blank keys are dropped.

    One step keeps each key once. Only the columns that are needed should come in: every copy is moved to its key. Add ``event_time`` and
    ``forget_after`` to bound the state: keys are then forgotten after that delay, which lets late copies through.
    """
    keyed = rows.withColumn("norm", dedup_key(key)).filter(F.col("norm") != "")
    if event_time and forget_after:
        return keyed.withWatermark(event_time, forget_after).dropDuplicatesWithinWatermark(["norm"])
    return keyed.dropDuplicates(["norm"])


def first_of_batch(batch: DataFrame, key: Col) -> DataFrame:
    """One row per lowered, trimmed key of a batch, with ``norm``, the key; every task folds its own rows first."""
    keyed = batch.withColumn("norm", dedup_key(key)).filter(F.col("norm") != "")
    return keyed.groupBy("norm").agg(F.first(F.struct(*batch.columns)).alias("row")).select("row.*", "norm")


def stream_first_seen_table(rows: DataFrame, key: Col, table: VersionedTable, path: str, checkpoint: str, writer: str) -> StreamingQuery:
    """First-seen over the whole life of the stream with the seen keys in a versioned table instead of operator state.

    A micro-batch is folded to one row a key in every task before anything moves, however often a key comes; only then keys are held against the
    table, by its filters first. New rows go to ``path``, one folder per writer and batch, with ``norm``, the key; then their keys
    are committed. A replay finds its batch committed and leaves both as they are; one that stopped in between writes its folder anew.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if table.manifest().writers.get(writer, -1) >= batch_id:
            return
        firsts = first_of_batch(batch, key)
        out = f"{path}/writer={writer}/batch_id={batch_id}"
        table.unknown(firsts, "norm").write.mode("overwrite").parquet(out)
        table.commit(batch.sparkSession.read.schema(firsts.schema).parquet(out).select("norm"), writer, batch_id)

    return _start(rows, checkpoint, each)


def seen_keys(spark: SparkSession, path: str, buckets: int = 64) -> VersionedTable:
    """The table of seen keys for :func:`stream_first_seen_table`."""
    return VersionedTable(spark, path, "norm", lambda keys: keys.select("norm").distinct(), buckets)


def stream_upsert_table(writes: DataFrame, table: VersionedTable, checkpoint: str, writer: str) -> StreamingQuery:
    """Merge every micro-batch into a versioned leads table as a batch of ``writer``: readers always find the state after whole batches."""
    return _start(writes, checkpoint, lambda batch, batch_id: table.commit(fold_state(batch), writer, batch_id))


def stream_unknown(links: DataFrame, table: VersionedTable, path: str, checkpoint: str, writer: str, url: str = "link") -> StreamingQuery:
    """As :func:`stream_without_known`, against a versioned table: links its filters rule out read none of its URLs."""
    return _start(links, checkpoint, lambda batch, batch_id: table.unknown(batch, url).write.mode("overwrite").parquet(f"{path}/writer={writer}/batch_id={batch_id}"))


def _start(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(writes: DataFrame, path: str, checkpoint: str, writer: str) -> StreamingQuery:
    """Append every micro-batch to the write log as a batch of ``writer``; the fold depends on the writes only, so replays change nothing.

    Batch numbers belong to a checkpoint: a stream that starts with a new one needs a new writer name.
    """
    return _start(writes, checkpoint, lambda batch, batch_id: append_writes(batch, path, writer, batch_id))


def stream_without_known(links: DataFrame, stored: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, writer: str,
                         url: str = "link") -> StreamingQuery:
    """Write links that are not in the leads table, which is read anew for every micro-batch, its URLs only. ``writer`` as above."""

    def each(batch: DataFrame, batch_id: int) -> None:
        known = known_urls(stored(batch.sparkSession)).select(F.col("source_url").alias(url))
        batch.join(known, url, "left_anti").write.mode("overwrite").parquet(f"{path}/writer={writer}/batch_id={batch_id}")

    return _start(links, checkpoint, each)


def stream_to_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
