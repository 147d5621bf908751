from pyspark.sql import functions as F

from leadweave.llm import mixing
from tests.llm.cases import odd_docs, prose, unchanged


def poured(sizes, weights, share=1.5, most=2.0):
    """Targets by pouring round after round."""
    target, open_ones, left = {}, set(sizes), share * sum(sizes.values())
    while open_ones:
        rate = left / sum(weights[s] for s in open_ones)
        full = {s for s in open_ones if most * sizes[s] < rate * weights[s]}
        if not full:
            return target | {s: rate * weights[s] for s in open_ones}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ones -= full
    return target


def test_targets_match_pouring(spark):
    sizes = {f"s{i:02d}": s for i, s in enumerate([900, 10, 300, 5000, 40, 0, 2000, 77])}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weighted = mixing.cycled_weights(table)
    weights = {r.source: r.weight for r in weighted.collect()}
    assert [weights[s] for s in sorted(sizes)] == [3, 1, 2, 3, 1, 2, 3, 1]
    got = {r.source: r.target for r in mixing.source_targets(weighted).collect()}
    assert all(abs(got[s] - t) < 1e-6 for s, t in poured(sizes, weights).items())


def test_odd_rows_and_limits(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix(docs)
    unchanged(mixed, docs, "size", "source_size", "target", "copies", "taken")
    rows = mixed.collect()
    assert all(r.size == len((r.text or "").encode().split()) and r.taken in (0, r.size, 2 * r.size) for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert mine[0].source_size == sum(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_reruns_agree_and_miss_by_half_a_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 300).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    taken = lambda d: {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    once = taken(docs)
    assert once == taken(docs.repartition(7))
    by_source = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 150 for r in by_source)


def test_unequal_chances(spark):
    """Documents with three times the preference get about three times the copies."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(prose(1, 20)).alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(docs, preference=F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(0.5), share=0.3)
    n = {r.even: r.n for r in mixed.groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("copies").alias("n")).collect()}
    assert n[True] + n[False] == 1200 and 2.6 < n[True] / n[False] < 3.4
