"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks, decided by weighted shingles.

An item's words (A-Z lowered, cut at white space) give its shingles; its fingerprint is the 64-bit SimHash of them, each weighed by how
often it occurs. Windows of as many words as the item slide over a document word by word; those that hold at least ``percent`` *
(m + n) / (100 + ``percent``) shingles of items of their length, as any similar window of m shingles has to for an item of n, get a
fingerprint. Fingerprints are cut into ``RADIUS`` + 1 blocks: two that differ in at most ``RADIUS`` bits agree in one, so the join on window
length, block number and block finds them all. The weighted Jaccard of the shingles, sum of smaller over sum of larger counts, decides
among these candidates.

SimHash bounds no similarity: of windows at the threshold, about ten bits differ on average, with a spread of three. A radius of 21 finds at least 98
of 100 windows of similarity 0.80 to 0.85 (held by a test against the exact way, which finds all: ``exact=True`` makes candidates by the item's
rarest shingles, one more than a similar window can lack, instead of fingerprints).

Items of fewer words than a shingle are one shingle of all their words. A document shorter than an item is one window, its whole text.

Defined cases: null text or no word matches nothing, and an item without words matches nothing. Rows of one id are told apart by
their text. Documents without an id are searched like others. Repeated rows are reported once. Of equally similar
windows the first one is reported. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import BROADCAST_ROWS, SHINGLE, SPACES, ascii_lower, written

RADIUS = 21
PERCENT = 80


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), f"[{SPACES}]+"), lambda w: w != "")


def shingles(tokens: str, width: int) -> Column:
    """Hash of every run of ``width`` words."""
    last = F.size(tokens) - width
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(width)]))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str, digits: int) -> Column:
    """Bit j is set if more than half of the shingles have it set; repeats count as often as they occur.

    The 64 counts are kept as ``digits`` longs, one per binary digit: a shingle is added to all of them at once by carrying, and all are
    compared at once with half the number of shingles, from the highest digit down. ``digits`` has to hold that number.
    """
    names, zero = [f"d{i}" for i in range(digits)], F.lit(0).cast("bigint")

    def add(counts: Column, h: Column) -> Column:
        out, carry = [], h
        for name in names:
            out.append(counts[name].bitwiseXOR(carry).alias(name))
            carry = counts[name].bitwiseAND(carry)
        return F.struct(*out)

    def more_than_half(counts: Column) -> Column:
        half, more, same = F.floor(F.size(hashes) / 2), zero, F.lit(-1).cast("bigint")
        for i in reversed(range(digits)):
            digit = -F.shiftright(half, i).bitwiseAND(F.lit(1))  # all ones or all zeros
            more = more.bitwiseOR(same.bitwiseAND(counts[names[i]]).bitwiseAND(F.bitwise_not(digit)))
            same = same.bitwiseAND(F.bitwise_not(counts[names[i]].bitwiseXOR(digit)))
        return more

    return F.aggregate(hashes, F.struct(*[zero.alias(n) for n in names]), add, more_than_half)


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """The fingerprint's ``radius`` + 1 pieces of consecutive bits."""
    borders = [64 * b // (radius + 1) for b in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fingerprint, start).bitwiseAND(F.lit((1 << (end - start)) - 1)) for start, end in zip(borders, borders[1:])])


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of smaller counts and sum of larger counts, as a struct of two longs.

    Where one side repeats nothing, the first is the number of values in both. Else the sorted values of both sides are gone through once.
    """
    zero = F.lit(0).cast("bigint")

    def marks(side: str, of_b: int) -> Column:
        return F.transform(side, lambda h: F.struct(h.alias("h"), F.lit(of_b).cast("bigint").alias("of_b")))

    marked = F.array_sort(F.concat(marks(a, 0), marks(b, 1)))

    def step(s: Column, x: Column) -> Column:
        same = s["h"].eqNullSafe(x["h"])
        return F.struct(x["h"].alias("h"), (F.when(same, s["in_a"]).otherwise(zero) + 1 - x["of_b"]).alias("in_a"), (F.when(same, s["in_b"]).otherwise(zero) + x["of_b"]).alias("in_b"),
                        (s["smaller"] + F.when(same, zero).otherwise(F.least(s["in_a"], s["in_b"]))).alias("smaller"))

    start = F.struct(F.lit(None).cast("bigint").alias("h"), zero.alias("in_a"), zero.alias("in_b"), zero.alias("smaller"))
    counted = F.aggregate(marked, start, step, lambda s: s["smaller"] + F.least(s["in_a"], s["in_b"]))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(F.array_intersect(a, b)).cast("bigint")).otherwise(counted)
    return F.struct(both.alias("smaller"), (F.size(a) + F.size(b) - both).alias("larger"))


def benchmark_index(items: DataFrame, item_id: str = "item_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``item, width, length, hashes, entry, probes, fingerprint`` of the items that have words; a written table.

    ``probes`` are the item's rarest shingles among items of its length, one more than a similar window can lack.
    """
    named = items.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{text_col}`")).alias("tokens")).filter(F.size("tokens") > 0).distinct()
    widths = [named.filter(F.size("tokens") >= SHINGLE if w == SHINGLE else F.size("tokens") == w).select(
        "item", F.lit(w).alias("width"), F.size("tokens").alias("length"), shingles("tokens", w).alias("hashes")) for w in range(1, SHINGLE + 1)]
    hashed = written(reduce(DataFrame.unionByName, widths).withColumn("entry", F.monotonically_increasing_id()), "items")
    placed = hashed.select("entry", "width", "length", F.explode("hashes").alias("hash"))
    holders = placed.groupBy("width", "length", "hash").agg(F.count_distinct("entry").alias("held"))
    # counted with repeats, of which any may be the ones that are lacking
    lacking = F.floor((100 - percent) * F.size("ranked") / 100).cast("int")
    ranked = placed.join(holders, ["width", "length", "hash"]).groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("held", "hash"))).alias("ranked"))
    probes = ranked.select("entry", F.array_distinct(F.slice("ranked", F.lit(1), lacking + 1)["hash"]).alias("probes"))
    return written(hashed.join(probes, "entry").withColumn("fingerprint", simhash("hashes", count_digits(hashed))), "item-index")


def count_digits(index: DataFrame) -> int:
    """Binary digits of the largest number of shingles in an item, and so in a window."""
    return max(1, (index.agg(F.max(F.size("hashes"))).first()[0] or 0).bit_length())


def touched_windows(docs: DataFrame, index: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """``doc, version, length, hits``: documents that share enough shingles with items of that length, and where, in order."""
    wanted = index.filter(F.col("width") == width).select(F.explode("hashes").alias("hash"), "length").distinct()
    hashed = docs.select("doc", "version", F.posexplode(shingles("tokens", width)).alias("pos", "hash"))
    hits = hashed.join(wanted, "hash").groupBy("doc", "version", "length").agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    return hits.filter(100 * F.size("hits") >= percent * (F.col("length") - width + 1))


def spans(docs: DataFrame, touched: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """``span, doc, version, length, held, all, starts``: where in a document windows of a length hold enough hits to be similar to an item.

    A row a document and length, with all its shingles; a written table, so that its numbers ``span`` stay.
    """
    held = F.least(F.col("length"), F.size("tokens")) - width + 1  # shingles of a window
    joined = docs.join(touched, docs["version"].eqNullSafe(touched["of_version"]) & docs["doc"].eqNullSafe(touched["of"])).select(
        "doc", "version", "length", "hits", F.greatest(F.lit(0), F.size("tokens") - F.col("length")).alias("last"), held.alias("held"),
        F.ceil(percent * (F.col("length") - width + 1 + held) / (100 + percent)).cast("int").alias("need"), shingles("tokens", width).alias("all"))
    # a window holds enough hits if it reaches from one of them to the one that is need - 1 further
    until = lambda i: F.get("hits", i + F.col("need") - 1)
    runs = F.filter(F.sequence(F.lit(0), F.size("hits") - F.col("need")), lambda i: until(i) - F.get("hits", i) < F.col("held"))
    starts = F.array_distinct(F.flatten(F.transform(runs, lambda i: F.sequence(F.greatest(F.lit(0), until(i) - F.col("held") + 1), F.least("last", F.get("hits", i))))))
    placed = joined.filter(F.size("hits") >= F.col("need")).select(F.monotonically_increasing_id().alias("span"), "doc", "version", "length", "held", "all", starts.alias("starts"))
    return written(placed.filter(F.size("starts") > 0), "spans")


def _hashes() -> Column:
    return F.slice("all", F.col("start") + 1, F.col("held"))


def windows(found: DataFrame) -> DataFrame:
    """``span, length, start, hashes`` of every window of the spans."""
    return found.select("span", "length", "held", "all", F.explode("starts").alias("start")).select("span", "length", "start", _hashes().alias("hashes"))


def by_blocks(found: DataFrame, items: DataFrame, digits: int, radius: int) -> DataFrame:
    """``span, start, entry``: windows and items of one length whose fingerprints differ in at most ``radius`` bits."""
    prints = written(windows(found).select("span", "length", "start", simhash("hashes", digits).alias("print")), "prints")
    cut = prints.select("*", F.posexplode(blocks("print", radius)).alias("number", "block"))
    indexed = items.select("entry", "length", F.col("fingerprint").alias("item_print"), F.posexplode(blocks("fingerprint", radius)).alias("number", "block"))
    near = cut.join(indexed, ["length", "number", "block"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    return near.select("span", "start", "entry").distinct()


def by_probes(found: DataFrame, items: DataFrame) -> DataFrame:
    """``span, start, entry``: windows that hold one of the item's rarest shingles; exact."""
    pieces = windows(found).select("span", "length", "start", F.explode(F.array_distinct("hashes")).alias("probe"))
    return pieces.join(items.select("entry", "length", F.explode("probes").alias("probe")), ["length", "probe"]).select("span", "start", "entry").distinct()


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
            percent: int = PERCENT, radius: int = RADIUS, exact: bool = False) -> DataFrame:
    """``doc, version, item, start, length, similarity, distance``: the best window of every document and item that match.

    ``start`` counts words from 0. ``version`` is the hash of the document's text.
    """
    index = benchmark_index(items, item_id, item_text, percent)
    digits = count_digits(index)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("version"), words(F.coalesce(text, F.lit(""))).alias("tokens"))
    found = []
    for width in sorted(r.width for r in index.select("width").distinct().collect()):  # 1 to SHINGLE
        touched = written(touched_windows(rows, index, width, percent).withColumnsRenamed({"doc": "of", "version": "of_version"}), "touched")
        if touched.count() <= BROADCAST_ROWS:
            touched = F.broadcast(touched)
        held, items_of = spans(rows, touched, width, percent), index.filter(F.col("width") == width)
        near = by_probes(held, items_of) if exact else by_blocks(held, items_of, digits, radius)
        # a document's shingles meet an item's once, whatever the number of windows
        met = written(near.groupBy("span", "entry").agg(F.collect_list("start").alias("near")), "candidates")
        pairs = met.join(held.drop("starts"), "span").join(items_of.select("entry", "item", F.col("hashes").alias("item_hashes"), F.col("fingerprint").alias("item_print")), "entry")
        placed = pairs.select("doc", "version", "length", "held", "all", "item", "item_hashes", "item_print", F.explode("near").alias("start"))
        found.append(placed.withColumn("hashes", _hashes()).withColumn("j", weighted_jaccard("hashes", "item_hashes")))
    if not found:
        return rows.select("doc", "version", F.lit(None).cast(items.schema[item_id].dataType).alias("item"), F.lit(0).alias("start"), F.lit(0).alias("length"),
                           F.lit(0.0).alias("similarity"), F.lit(0).alias("distance")).filter("false")
    similar = reduce(DataFrame.unionByName, found).filter(100 * F.col("j.smaller") >= percent * F.col("j.larger"))
    best = F.max(F.struct((F.col("j.smaller") / F.col("j.larger")).alias("similarity"), (-F.col("start")).alias("before"), "length", "hashes", "item_print")).alias("best")
    chosen = similar.groupBy("doc", "version", "item").agg(best).select("doc", "version", "item", "best.*")
    distance = F.bit_count(simhash("hashes", digits).bitwiseXOR(F.col("item_print")))
    return chosen.select("doc", "version", "item", (-F.col("before")).alias("start"), "length", "similarity", distance.alias("distance"))


def without_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window that matches an item."""
    hit = written(matches(docs, items, id_col, text_col).select("doc", "version").distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return docs.join(hit, docs[id_col].eqNullSafe(hit["doc"]) & (F.xxhash64(docs[text_col]) == hit["version"]), "left_anti")
