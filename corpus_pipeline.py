"""A training corpus out of ``documents``: judged, deduplicated by line and by document, decontaminated, mixed.

Each stage takes the documents that the one before has kept and returns documents again, with the columns of the input. The last one
returns a row for each copy that the mix takes, numbered by ``copy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm import decontaminate, line_dedup, mixing, parity_join, quality_rules
from leadweave.llm.common import BROADCAST_ROWS, WORD, written

ORACLE_SQL = None  # hashed n-gram ratios, near-duplicate components and SimHash windows are not expressible in SQL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. An id is not needed to pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return quality_rules.judge_quality(docs, labels).filter("kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that a smaller document holds; ``n_chars`` follows. One that loses lines and has no word left goes."""
    kept = line_dedup.dedup_lines(docs.select(*docs.columns)).filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of linked ones, told apart by id and text; rows repeated in full stay once.

    A document without an id is larger than any with one; without a word too, it stays.
    """
    linked = parity_join.near_duplicates(docs.select("doc_id", "text"))
    gone = written(linked.filter("NOT chosen").select("doc", "version").distinct(), "near-copies")
    again = linked.filter("chosen AND (n_shingles > 0 OR doc IS NOT NULL)").groupBy("doc", "version").count().filter("count > 1")
    twice = written(again.select("doc", "version"), "repeated-rows")
    gone, twice = (F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows for rows in (gone, twice))

    def same(rows: DataFrame, listed: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(listed["doc"]) & (F.xxhash64(rows["text"]) == listed["version"])

    left = docs.join(gone, same(docs, gone), "left_anti")
    repeated = left.join(twice, same(left, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same(left, twice), "left_anti").unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, with ``size``, ``source_size``, ``target``, ``taken`` and ``copy`` from 1."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


STAGES = [("quality rules", quality), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_dedup),
          ("benchmark decontamination", decontamination), ("mixing sources", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = written(docs, f"stage-{place}")
    return docs
