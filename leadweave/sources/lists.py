"""Target lists: text files and comma lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.functions.lists import Col, col
from leadweave.functions.text import trim_space
from leadweave.session import write_once


def clean_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Trim every line; drop empty ones and those starting with ``#``. Duplicates stay."""
    return lines.withColumn(line, trim_space(line)).filter((F.col(line) != "") & ~F.col(line).startswith("#"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, row, line`` of the kept lines; sorting by the first three gives file order.

    The place is the start of the file block and a number rising within it, so reading stays distributed.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    return clean_lines(rows)


BROADCAST_ROWS = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord, line``: the kept lines of all files, numbered from 0 without gaps in order of file and place.

    Two passes over the text, and no line moves: kept lines and their least number are counted by file block, blocks and then files are added up in order,
    and each line adds its block's start to its place in it. The sums hold one row a block; they are broadcast if counted to be few.
    """
    lines = clean_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")))
    lines = lines.withColumn("row", F.monotonically_increasing_id())  # after the filter: without gaps within a block
    by_block = write_once(lines.groupBy("file", "block").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")), "line-blocks")
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_file = by_block.groupBy("file").agg(F.sum("n").alias("lines"))
    before = by_file.withColumn("files_before", F.coalesce(F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a file
    starts = by_block.withColumn("in_file", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(before, "file").select("file", "block", "least", (F.col("files_before") + F.col("in_file")).alias("start"))
    if by_block.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["file", "block"]).select((F.col("start") + F.col("row") - F.col("least")).alias("ord"), "line")


def list_items(rows: DataFrame, values: Col, keep: list[str]) -> DataFrame:
    """Items of a comma list with their place: split, trimmed, blanks dropped, order kept."""
    items = rows.select(*keep, F.posexplode(F.split(col(values), ",")).alias("pos", "value"))
    return items.withColumn("value", trim_space("value")).filter(F.col("value") != "")


def target_list(listed: DataFrame, lines: DataFrame) -> DataFrame:
    """Comma-list items, then file lines, as one list; nothing is deduplicated.

    ``source, ord, pos, value``, where ``lines`` has a place ``ord``, as from :func:`numbered_lines`. Lines from :func:`read_lines` have a place in a file
    instead: sort by ``source, file, block, ord, pos`` then.
    """
    first = listed.select(F.lit(0).alias("source"), "ord", "pos", "value")
    if "ord" in lines.columns:
        return first.unionAll(lines.select(F.lit(1).alias("source"), "ord", F.lit(0).alias("pos"), F.col("line").alias("value")))
    placed = first.select("source", F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("ord").cast("bigint").alias("ord"), "pos", "value")
    return placed.unionAll(lines.select(F.lit(1), "file", "block", "row", F.lit(0), "line"))
