"""Line dedup across documents: hashes dealt by range, a secondary sort, and keep bitmaps instead of text.

Every line long enough becomes one narrow row (two 64-bit hashes of its key, document, position). The rows are dealt by hash
range and sorted by hash, document and position, so that each first occurrence is seen before its repeats. What comes out per
document is a bitmap of kept lines as runs; the text is met again only by :func:`dedup_lines`.

Defined cases: null or empty text is one empty line. A key within one document only loses nothing, however often it repeats. A
document without an id counts as one document after all others. Rows of one id are one document, each with a bitmap of its own
text; repeated rows share it. An empty table gives an empty result. Input columns named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import SPACES, ascii_lower, packed, unpacked, written

MIN_CHARS = 10
# A key of more than one in HOT_SHARE of all line rows is hot: there are fewer than HOT_SHARE of them, which bounds their broadcast.
HOT_SHARE = 1000


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _version(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, doc, version, pos`` of every line whose key has at least ``min_chars`` code points; input ``doc, text``."""
    lines = docs.select("doc", _version("text").alias("version"), F.posexplode(_lines("text")).alias("pos", "line"))
    trimmed = lines.select("doc", "version", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).filter(F.char_length("key") >= min_chars)
    lowered = ascii_lower("key")
    return trimmed.select(F.xxhash64(lowered).alias("h1"), F.xxhash64(F.lit(1), lowered).alias("h2"), "doc", "version", "pos")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """``doc, version, pos`` of the lines whose key a smaller document holds. ``lines`` has to be a written table.

    A hot key would be one task's work, as its range can't be cut. Hot keys get their first document from a sum with partial
    results, and their lines are looked up where they are; all other lines go through the range and the sort.
    """
    by_key = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc").isNull(), F.col("doc").alias("doc"))).alias("first"))
    hot = written(by_key.filter(F.col("n") * HOT_SHARE > F.lit(lines.count())).select("h1", "h2", F.col("first.doc").alias("owner")), "hot-lines")
    cold = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    order = [F.col("doc").asc_nulls_last(), F.col("version"), F.col("pos")]
    dealt = cold.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    streamed = dealt.withColumn("owner", F.first("doc").over(Window.partitionBy("h1", "h2").orderBy(*order)))
    owned = streamed.unionByName(lines.join(F.broadcast(hot), ["h1", "h2"]))
    return owned.filter(~F.col("doc").eqNullSafe(F.col("owner"))).select("doc", "version", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc, version, n_dropped, kept_runs`` of every document that loses lines; input ``doc, text``.

    ``kept_runs`` is the bitmap of kept lines, compressed to its runs of ones: first line and the line after the last, which is
    null in a run that goes on to the end.
    """
    dropped = dropped_lines(written(line_rows(docs, min_chars), "lines"))
    gathered = dropped.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.lit(None).cast("int"))),
                      lambda p, q: F.struct((p + 1).alias("start"), q.alias("end")))
    return gathered.select("doc", "version", F.size("gone").cast("bigint").alias("n_dropped"),
                           F.filter(runs, lambda r: r["end"].isNull() | (r["end"] > r["start"])).alias("kept_runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with the text of their kept lines, and ``n_lines``, ``n_dropped``."""
    rows = packed(docs, doc=id_col, text=text_col)
    bitmaps = keep_bitmaps(rows.select("doc", "text"), min_chars).select(F.col("doc").alias("of"), F.col("version").alias("of_version"), "n_dropped", "kept_runs")
    joined = (rows.withColumn("version", _version("text"))
              .join(bitmaps, F.col("doc").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
              .withColumn("lines", _lines("text")))
    pieces = F.transform("kept_runs", lambda r: F.slice("lines", r["start"] + 1, F.coalesce(r["end"], F.size("lines")) - r["start"]))
    text = F.when(F.col("kept_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return unpacked(joined, docs, **{text_col: text, "n_lines": F.size("lines").cast("bigint"), "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("bigint"))})
