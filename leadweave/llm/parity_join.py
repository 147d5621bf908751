"""N-gram Jaccard join by parity sketches: all pairs of documents whose shingle sets reach the similarity, and their components.

Every shingle flips one bit of a sketch, so two sketches differ in at most as many bits as the sets differ in shingles. Two sets of
sizes a and b reach Jaccard J only if they differ in at most (1 - J) / (1 + J) * (a + b) shingles.

*Pigeonhole join.* Sizes fall into bands; a set belongs to its band and, as the smaller side, to the next one it can reach. A
band's radius r is the largest difference of any pair in it. The band's sketch is cut into r + spare blocks, each as wide as the
64-bit hash space and kept as the XOR of its shingles' hashes: a difference of r shingles leaves ``spare`` blocks equal. Empty
blocks make no key; a set with too many of them gets another deal of the blocks, and another, until at least ``SHARED`` of the equal
blocks of any of its pairs hold shingles. Equal keys make candidates; a set with fewer shared keys has no link.

*No pairs within keys.* A key's sets are first compared with its smallest and largest node only; sets found linked are one component, and
keys within one component are done. Both nodes have met all of the key and leave it, so keys of three sets are done too. Of the sets in
other keys, shingles that no set of another component holds can't be in an intersection that matters: the number of held ones bounds every similarity, and most sets that share a passage or are edited too much drop out by it. Then come
rounds of pivots: in each, ``PIVOTS`` sets of every open key are compared with its other sets of other components where this bound and a wide
sketch allow, so a round costs a key's size. Links found contract components, keys within one component close, and pivots leave
their keys, as they have met all. When a round finds no link, or after ``ROUNDS``, what is still open is paired: sets of keys with at most ``SMALL_KEY`` sets
with each other, sets of larger ones where they meet in two large keys at once (large keys are dealt to one share fewer than a pair
has keys, so that two of them are in one share).

*Verify.* Narrow sketches of about one bit per shingle drop most candidates by Hamming distance; whole sets decide the rest.

Equal sets are one node from the start, however many copies there are. Shingles and sets are told apart by 64-bit hashes.

Defined cases: null text or one without words has no shingle, links with nothing and is its own component. Fewer words than a
shingle are one shingle. Documents without an id can link others but never name a component. Repeated rows give repeated rows.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadweave.llm.common import BROADCAST_ROWS, mixed, shingle_set, written

PERCENT = 80
_ODD = np.uint64(0xD6E8FEB86659FD93)
WIDE = 16  # words of the sketch that leftover pairs are compared by
SHARED = (2, 4, 8, 12)  # keys that linked sets share at least, by the level of the radius
TOGETHER = 100_000  # shingles whose keys are made in one go
SMALL_KEY = 32  # keys of more sets are refined by a second key; no pair depends on it
PIVOTS, ROUNDS = 8, 8  # sets that a key's others are compared with in a round, and most rounds; no pair depends on them


@cache
def bands(n: int) -> list[int]:
    """Index of the size's band, and of the next one if a set of this size can link into it. Band borders grow by 100 / PERCENT."""
    low, band = 1, 0
    while True:
        high = max(low, low * 100 // PERCENT)
        if n <= high:
            return [band, band + 1] if (high + 1) * PERCENT <= 100 * n else [band]
        low, band = high + 1, band + 1


@cache
def radius(band: int) -> int:
    """Largest symmetric difference of two linked sets whose larger one is in the band."""
    low = 1
    for _ in range(band):
        low = max(low, low * 100 // PERCENT) + 1
    return 2 * max(low, low * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def shared_keys(r: int) -> int:
    """Keys that two linked sets share at least, by construction."""
    return SHARED[level(r)]


def level(r):
    """0 to 3, of a radius or an array of them."""
    return 1 * (r >= 4) + (r >= 32) + (r >= 64)


def spare_blocks(r: int) -> int:
    return shared_keys(r) + 3 + r // 6 if level(r) else 4


def signature_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets, and for each key the place of its set in the list.

    Sets that reach the similarity share as many keys of one deal as ``shared_keys`` says. The low byte of a key tells the deals of a set apart,
    and by two of its bits how many keys that is. A radius of 0 makes no key: only equal sets link, and those are one node.
    """
    made, owners, deal = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    units = [(i, band) for i, s in enumerate(sets) for band in (bands(len(s)) if len(s) else []) if radius(band)]
    while units:
        owner, band = (np.array(x) for x in zip(*units))
        r = np.array([radius(b) for b in band])
        blocks = np.array([radius(b) + spare_blocks(radius(b)) for b in band])
        unit = np.repeat(np.arange(len(units)), [len(sets[i]) for i in owner])
        flat = np.concatenate([sets[i] for i in owner])
        frame = mixed((band << 20 | deal).astype(np.uint64))
        spread = (flat ^ frame[unit]) * _ODD  # shingles are well mixed hashes already: one product deals them anew
        first = np.cumsum(blocks) - blocks
        place = first[unit] + ((spread >> np.uint64(32)) * blocks[unit].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(place)
        dealt = place[order]
        starts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
        parity, of = np.bitwise_xor.reduceat(flat[order], starts), unit[order[starts]]
        keys = mixed(mixed(parity) ^ mixed(frame[of] + (dealt[starts] - first[of]).astype(np.uint64)))
        made.append(keys & ~np.uint64(0xFF) | ((8 * deal + 2 * level(r[of]) + band[of] % 2) & 0xFF).astype(np.uint64))
        owners.append(owner[of])
        occupied = np.bincount(of, minlength=len(units))
        units = [u for u, held, least in zip(units, occupied, r) if held < least + shared_keys(int(least))]
        deal += 1
    return np.concatenate(made), np.concatenate(owners)


def sketch(shingles: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parity bits as 64-bit words: as many as given, else a power of two and at least one bit per shingle."""
    width = 64 * words if words else max(64, 1 << (max(1, len(shingles)) - 1).bit_length())
    bits = ((shingles * _ODD >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=width) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def node_id(shingles: np.ndarray) -> int:
    """64-bit digest of the whole set."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "little", signed=True)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_id(s) for s in sets], pa.int64()),
                                          pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), batch.column(2)], ["doc", "n", "node", "sketch", "version"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, owners = signature_keys(sets)
        nodes = np.array([node_id(s) for s in sets], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[owners])], ["key", "node"])

    sets, held = [], 0
    seen: set[int] = set()  # nodes this task has made keys for: of copies one will do
    for batch in batches:
        for text in batch.column(0):
            shingles = shingle_set(text.as_py())
            node = node_id(shingles)
            if node in seen:
                continue
            seen.add(node)
            sets.append(shingles)
            held += len(shingles)
            if held >= TOGETHER:
                yield made(sets)
                sets, held = [], 0
    if sets:
        yield made(sets)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            shingles = shingle_set(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([node_id(shingles)]), pa.array([shingles.view(np.int64)], pa.list_(pa.int64())),
                                              pa.array([sketch(shingles, WIDE)], pa.list_(pa.int64()))], ["node", "shingles", "wide"])


def _hamming(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the wider one folded to the other's width, which keeps parities."""
    least = F.least(F.size(a), F.size(b))

    def folded(s: str) -> Column:
        return F.when(F.size(s) > least, F.zip_with(F.slice(s, F.lit(1), least), F.slice(s, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(s))

    differing = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.aggregate(differing, F.lit(0).cast("long"), lambda s, d: s + d)


def _whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``node, shingles`` of the wanted nodes, from the text of one document each; a written table."""
    first = written(nodes.join(wanted, "node", "left_semi").select("doc", "version"), f"first-{name}")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = docs.alias("d").join(first.alias("f"), (F.col("d.version") == F.col("f.version")) & F.col("d.doc").eqNullSafe(F.col("f.doc")), "left_semi")
    return written(rows.select("text").mapInArrow(_sets, "node long, shingles array<long>, wide array<long>").dropDuplicates(["node"]), f"sets-{name}")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, name: str, sets: DataFrame | None = None) -> DataFrame:
    """The distinct ``a, b`` pairs of nodes that reach the similarity: by size, by sketch, then by whole sets, made anew where none are given."""
    sides = [nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"]
    near = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    near = near.filter((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
                       & ((100 + PERCENT) * _hamming("sketch_a", "sketch_b") <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))))
    near = written(near.select("a", "b"), f"near-{name}")
    if sets is None:
        sets = _whole_sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, name)
    whole = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    sized = whole.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return written(sized.filter(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("a", "b"), f"links-{name}")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``a, b`` links, the component named by its smallest node.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours likewise. Links become stars; the rounds grow with the logarithm of a component's size. Only sums come to the driver.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").filter("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def contracted(found: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after more links: only the components they join are worked on."""
    ends = [found.select(F.col("node").alias(s), F.col("component").alias(f"component_{s}")) for s in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b")).filter("a <> b")
    moved = components(written(between.distinct(), "joined")).withColumnsRenamed({"node": "was", "component": "now"})
    kept = found.join(moved, found["component"] == moved["was"], "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = moved.join(found.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return written(kept.unionByName(fresh), "found")


def _possible() -> Column:
    """Whether rows a and b may reach the similarity by their held shingles and wide sketches."""
    inner, sum_ = F.least("held_a", "held_b"), F.col("n_a") + F.col("n_b")
    differing = reduce(Column.__add__, [F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(WIDE)])
    return (100 * inner >= PERCENT * (sum_ - inner)) & ((100 + PERCENT) * differing <= (100 - PERCENT) * sum_)


def _with_pivots_marked(keyed: DataFrame, step: int) -> DataFrame:
    """The rows with ``pivot``, true for up to ``PIVOTS`` nodes of every key, others in every round."""
    least = [F.min_by("node", F.xxhash64("node", F.lit(PIVOTS * step + i))) for i in range(PIVOTS)]
    chosen = keyed.groupBy("key").agg(F.array(*least).alias("pivots"))
    return keyed.join(chosen, "key").withColumn("pivot", F.array_contains("pivots", F.col("node"))).drop("pivots")


def _side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    return rows.select("key", *more, *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "n", "held", *[f"w{i}" for i in range(WIDE)])])


def _pivot_pairs(marked: DataFrame) -> DataFrame:
    """``a, b``: the pivots of a key and its rows of other components that may be linked with them."""
    met = _side(marked, "b", "pivot").join(_side(marked.filter("pivot"), "a"), "key").filter((F.col("component_a") != F.col("component_b")) & (~F.col("pivot") | (F.col("node_a") < F.col("node_b"))) & _possible())
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _across(keyed: DataFrame) -> DataFrame:
    """``a, b`` of the rows with the same key but not the same component, where their held shingles and wide sketches allow the similarity."""
    a, b = (_side(keyed, s) for s in "ab")
    met = a.join(b, (a["key"] == b["key"]) & (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _possible())
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _mixed_keys(keyed: DataFrame) -> DataFrame:
    """Rows of the keys that hold more than one component, with the number of rows ``rows_of_key``."""
    by_key = keyed.groupBy("key").agg(F.count("*").alias("rows_of_key"), F.min("component").alias("low"), F.max("component").alias("high"))
    return keyed.join(by_key.filter("low <> high").select("key", "rows_of_key"), "key")


def _needed(deal: str) -> Column:
    """Keys that a link needs, from the low byte of a key."""
    return F.element_at(F.array(*map(F.lit, SHARED)), F.shiftright(F.col(deal), 1).bitwiseAND(F.lit(3)).cast("int") + 1)


def _enough_keys(shared: DataFrame) -> DataFrame:
    """Rows of ``key, node`` of the sets that share as many keys of one deal as a link needs."""
    dealt = shared.withColumn("deal", F.col("key").bitwiseAND(F.lit(0xFF)))
    enough = dealt.groupBy("node", "deal").agg(F.count("*").alias("keys")).filter(F.col("keys") >= _needed("deal")).select("node", "deal")
    return dealt.join(enough, ["node", "deal"]).select("key", "node")


def held_shingles(sets: DataFrame) -> DataFrame:
    """``node, n, held, w0...`` of whole sets with ``component``: the size, how many of the shingles a set of another component holds, the wide sketch."""
    tokens = sets.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    known = tokens.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    held = tokens.join(known, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("held"))
    return held.filter(100 * F.col("held") >= PERCENT * F.col("n")).join(sets.select("node", *[F.get("wide", F.lit(i)).alias(f"w{i}") for i in range(WIDE)]), "node")


def all_components(shared: DataFrame, found: DataFrame, tested: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, component`` over all links of sets that share keys, from the components ``found`` so far and the pairs ``tested`` for them.

    ``shared`` is ``key, node, low, high``: the key's smallest and largest node have met all of it, so both leave it.
    """
    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    unmet = shared.filter("node <> low AND node <> high").select("key", "node")
    open_rows = written(_enough_keys(_mixed_keys(labelled(unmet))), "open-keys")
    sets = _whole_sets(open_rows.select("node").distinct(), nodes, docs, "left")
    bounded = written(held_shingles(labelled(sets)), "held")
    rows = _enough_keys(open_rows.join(bounded, "node", "left_semi"))
    for step in range(ROUNDS):
        left = written(_with_pivots_marked(_mixed_keys(labelled(rows)), step).join(bounded, "node"), "mixed-keys")
        if not left.count():
            return found
        met = written(_pivot_pairs(left).join(tested, ["a", "b"], "left_anti"), "met")
        more = verified(met, nodes, docs, "pivots", sets)
        tested, rows = tested.unionByName(met), _enough_keys(left.filter("NOT pivot"))
        if not more.count():
            break
        found = contracted(found, more)
    left = written(_mixed_keys(labelled(rows)).join(bounded, "node"), "mixed-keys")
    more = verified(leftover_pairs(left, bounded).join(tested, ["a", "b"], "left_anti"), nodes, docs, "rest", sets) if left.count() else None
    return contracted(found, more) if more is not None and more.count() else found


def leftover_pairs(left: DataFrame, bounded: DataFrame) -> DataFrame:
    """Pairs that share a key and are not yet in one component, without forming the pairs of large keys."""
    large = left.filter(F.col("rows_of_key") > SMALL_KEY)
    dealt = large.withColumn("deal", F.col("key").bitwiseAND(F.lit(0xFF)))
    lists = dealt.groupBy("node", "deal", F.pmod(F.xxhash64("key"), _needed("deal") - 1).alias("share")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    twos = F.flatten(F.transform("keys", lambda k, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda l: F.xxhash64(k, l))))
    known = left.select("node", "component", *bounded.columns[1:]).distinct()
    double = written(_mixed_keys(lists.select("node", F.explode(twos).alias("key")).join(known.select("node", "component"), "node")), "double-keys")
    doubled = double.join(known.drop("component"), "node")
    return _across(left.filter(F.col("rows_of_key") <= SMALL_KEY)).unionByName(_across(doubled))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, n_shingles, component, version, chosen``: for every row its set's size and the smallest id among all documents it is linked with.

    ``version`` is the hash of the row's text. ``chosen`` tells the linked rows' first by id and version, ids before none, and rows without a word.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("text"), F.xxhash64(text).alias("version"))
    members = written(rows.select("doc", "text", "version").mapInArrow(_nodes, f"doc {dict(docs.dtypes)[id_col]}, n long, node long, sketch array<long>, version long"), "members")
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version")).alias("first")
    nodes = written(members.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), first).select("node", "n", "sketch", "first.doc", "first.version"), "nodes")
    keyed = rows.select("text").mapInArrow(_signatures, "key long, node long").repartition("key")
    over_key = Window.partitionBy("key")
    seen = keyed.withColumn("low", F.min("node").over(over_key)).withColumn("high", F.max("node").over(over_key))
    met = _enough_keys(written(seen.filter("low <> high").select("key", "node").distinct(), "met-keys"))
    shared = written(met.join(met.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high"), "key"), "shared-keys")
    ends = [shared.select(F.col("low").alias("a"), F.col("node").alias("b")), shared.select(F.col("node").alias("a"), F.col("high").alias("b"))]
    stars = written(ends[0].unionByName(ends[1]).filter("a < b").distinct(), "stars")
    links = verified(stars, nodes, rows, "stars")
    found = written(components(links), "found")
    found = all_components(shared, found, stars, nodes, rows)
    labelled = nodes.select("node", "doc", "version").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "version")).alias("least"))
    named = written(labelled.join(least, "component").select("node", F.col("least.doc").alias("least"), F.col("least.version").alias("least_version")), "named")
    joined = members.select("doc", "n", "node", "version").join(named, "node", "left")
    chosen = (F.col("n") == 0) | (F.col("doc").eqNullSafe(F.col("least")) & F.col("version").eqNullSafe(F.col("least_version")))
    return joined.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component"), "version", chosen.alias("chosen"))
