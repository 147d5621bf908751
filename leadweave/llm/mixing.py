"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target size. A document's expected number of copies is its source's target by size; its whole part is
allocated for certain, the rest is its inclusion probability p. Documents are ranked by random odds over inclusion odds,
u / (1 - u) over p / (1 - p), with u drawn from the document's id, and taken in that order until the source's target is filled:
the sample has a fixed size, in words, and a document's chance follows its own p. The last document is taken if that
brings the sum nearer to the target, so a source misses it by half a document at most.

The running sum over the ranks is not one task's work: ranks fall into ``RANK_BINS`` bins by value, sums per source and bin give
the bin where the target is reached, and only documents in that bin are sorted. Nothing moves but these and the sums.

Defined cases: null text has size 0 and is never short of its target. A null source is a source, last in order. Equal ranks go by
id, then text. Each repeated row is a document of its own. A source of size 0 has target 0. An empty table gives an
empty result. Input columns named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.common import WORD, unpacked, written

RANK_BINS = 4096
CYCLE = (3, 1, 2)
_TWO_52 = float(1 << 52)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Add ``weight``: the sources in code point order, null last, take the cycle's weights in turn. One row per source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (turn % len(cycle) + 1).cast("int")))


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``: ``share`` of all sizes dealt by weight, at most ``most`` times a size.

    In the order in which sources fill up, what is left goes by weight to those not yet full; the first one that stays below its
    limit gives the final rate. Windows run over one row per source.
    """
    filling = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    limit = sources.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rated = limit.withColumn("rate", left / heavy).withColumn("step", F.row_number().over(filling))
    open_ones = F.when(F.col("full_at") >= F.col("rate"), F.struct("step", "rate"))
    final = F.min(open_ones).over(Window.partitionBy())["rate"]
    return rated.withColumn("target", F.coalesce(F.least(F.col("limit"), final * F.col("weight")), F.col("limit"))).select("source", "source_size", "weight", "target")


def _drawn(docs: DataFrame, sources: DataFrame, seed: str, most: float) -> DataFrame:
    """Add whole copies, rank and rank bin to rows with ``doc, source, size``."""
    parted = docs.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size") * F.col("preference"))).otherwise(F.lit(0.0))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(_TWO_52)
    drawn = parted.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole")).withColumn("u", u)
    rank = F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
    return drawn.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_BINS))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: Column | None = None,
        share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, copies, taken``; ``copies`` is 0 for what the mix leaves out.

    ``preference`` (1 where not given, 1 on the whole) raises or lowers a document's expected copies, so that chances differ within a
    source. Reruns agree.
    """
    wanted = preference if preference is not None else F.lit(1.0)
    inputs = {"doc": id_col, "text": text_col, "source": source_col}
    rows = docs.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in inputs.items()], wanted.alias("preference")).withColumn("size", word_count("text"))
    narrow = written(rows.select("doc", "source", "size", "preference"), "sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(cycled_weights(totals), share, most), "sources")
    drawn = _drawn(narrow, sources, seed, most)
    sums = drawn.groupBy("source", "bin").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("drawn"),
                                              F.first("target").alias("target"))
    ordered = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_last())
    reached = sums.withColumn("before", F.coalesce(F.sum("drawn").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reached = reached.withColumn("left", F.col("target") - F.sum("certain").over(Window.partitionBy("source")))
    last = reached.filter(F.col("bin").isNotNull() & (F.col("before") <= F.col("left"))).groupBy("source").agg(
        F.max("bin").alias("last_bin"), F.max_by("before", "bin").alias("before"), F.max("left").alias("left"))
    last = written(last.withColumnRenamed("source", "of"), "last-bins")
    decided = _drawn(rows, sources, seed, most).join(last, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    edge = decided.filter(F.col("bin") == F.col("last_bin"))
    running = Window.partitionBy("source").orderBy("rank", F.col("doc").asc_nulls_last(), F.xxhash64("text"))
    edge = edge.withColumn("up_to", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = edge.withColumn("more", (F.col("before") + F.col("up_to") - F.col("size") / 2 <= F.col("left")).cast("bigint")).drop("up_to")
    sure = decided.filter(~F.coalesce(F.col("bin") == F.col("last_bin"), F.lit(False)))
    sure = sure.withColumn("more", F.coalesce((F.col("bin") < F.col("last_bin")).cast("bigint"), F.lit(0).cast("bigint")))
    copies = F.col("whole") + F.col("more")
    return unpacked(sure.unionByName(edge), docs, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=copies, taken=copies * F.col("size"))
