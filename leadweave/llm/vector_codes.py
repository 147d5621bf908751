"""Product quantisation of vectors: Lloyd rounds in which partition-local cover trees assign whole subtrees.

Vectors become integers (``floor(SCALE * x)``) and are cut into equal parts, each with a codebook of its own. The vectors of a partition
are packed into chunks, one row each, with a cover tree over every part: a node covers the points within its radius, its children lie within
half of that and cover them more closely, and it holds the number and the sum of all points below it. The chunks are written once. A round
goes through each tree from the top: a node whose centre is nearer to one entry than to any other by more than twice its radius gives
its whole subtree to that entry (triangle inequality), by adding its number and sum. Only nodes for which that is open go on to their children,
and only the points of leaves that stay open are compared one by one, with ties to the lower index. Distances are exact integers. A task
hands on counts and sums by entry only; the driver holds the codebooks, whose size depends on no table.

The first codebook is made of the vectors with the smallest ids. Nothing is sampled, and every vector is coded.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so are rows with another
length than most vectors (ties: the shorter length); that length has to be a multiple of ``parts``. Fewer vectors than ``entries`` make a smaller codebook.
Rows with the same id are coded each; among equal ids the smaller vector comes first into the codebook, null ids come last. Components are held
within +-2 ** 27 after scaling, so that no distance overflows. An empty table gives an empty result. Extra columns stay away, but for
those in ``carry``, under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm.common import BROADCAST_ROWS, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 27
CHUNK = 1 << 18  # components a row of packed vectors holds
LEAF = 8         # points a node keeps without children
_EXACT = 1 << 50  # below it, products of floating-point numbers that hold integers are exact


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, as exact integers."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * points.shape[1] * largest * largest < _EXACT else np.int64
    p, b = points.astype(kind), book.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


@dataclass
class Tree:
    """Nodes from the top down; ``level`` rises. ``leaf`` is the node that each point ends in."""

    level: np.ndarray
    parent: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    leaf: np.ndarray

    FIELDS = {"level": np.int16, "parent": np.int32, "centre": np.int32, "radius": np.float64, "counts": np.int32, "sums": np.int64, "leaf": np.int32}

    def packed(self) -> dict[str, bytes]:
        return {n: np.ascontiguousarray(getattr(self, n), kind).tobytes() for n, kind in self.FIELDS.items()}

    @classmethod
    def unpacked(cls, fields: dict[str, bytes]) -> Tree:
        tree = cls(**{n: np.frombuffer(fields[n], kind) for n, kind in cls.FIELDS.items()})
        tree.sums = tree.sums.reshape(len(tree.level), -1)
        return tree


def cover_tree(points: np.ndarray, leaf_size: int = LEAF) -> Tree:
    """A cover tree over the points, built a level at a time for all nodes of that level together."""
    n = len(points)
    node, apart = np.zeros(n, np.int64), _apart(points, points[np.zeros(n, np.int64)])
    level, parent, centre = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)]
    total, scale, depth = 1, float(apart.max()), 0
    centres = np.zeros(1, np.int64)  # of all nodes so far
    while scale > 0.5:  # integer points closer than that are equal
        scale, depth = scale / 2, depth + 1
        radius, size = np.zeros(total), np.bincount(node, minlength=total)
        np.maximum.at(radius, node, apart)
        split = (radius > scale) & (size > leaf_size)
        moving = np.flatnonzero(split[node])
        if not len(moving):
            if not ((radius > 0) & (size > leaf_size)).any():
                break
            continue
        moving = moving[np.argsort(node[moving], kind="stable")]
        group = node[moving].copy()
        while len(moving):
            parents, first = np.unique(group, return_index=True)
            # a group's first child keeps its centre, each later one begins at the first point not covered yet
            fresh = np.where(split[parents], centres[parents], moving[first])
            split[parents] = False
            at = np.searchsorted(parents, group)
            near = _apart(points[moving], points[fresh[at]])
            covered = near <= scale
            node[moving[covered]], apart[moving[covered]] = total + at[covered], near[covered]
            level.append(np.full(len(parents), depth))
            parent.append(parents)
            centre.append(fresh)
            centres = np.concatenate([centres, fresh])
            total += len(parents)
            moving, group = moving[~covered], group[~covered]
    level, parent, centre = (np.concatenate(x) for x in (level, parent, centre))
    counts, sums, radius = np.bincount(node, minlength=total), np.zeros((total, points.shape[1]), np.int64), np.zeros(total)
    np.add.at(sums, node, points)
    deepest = int(level[-1])
    above = node.copy()
    for depth in range(deepest, -1, -1):  # numbers and sums flow up; a radius is the largest distance of any point below
        here = np.flatnonzero(level == depth)
        mine = level[above] == depth
        np.maximum.at(radius, above[mine], _apart(points[mine], points[centre[above[mine]]]))
        if depth:
            np.add.at(counts, parent[here], counts[here])
            np.add.at(sums, parent[here], sums[here])
            above[mine] = parent[above[mine]]
    return Tree(level, parent, centre, radius, counts, sums, node)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances, rounded up a little, as they bound other distances."""
    return np.sqrt(((a - b) ** 2).sum(1).astype(np.float64)) * (1 + 1e-12)


def assign(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes give their whole subtree to which entry (-1: none), the points left over, and their entries."""
    given = np.full(len(tree.level), -1)
    open_ = np.zeros(len(tree.level), bool)
    borders = np.searchsorted(tree.level, np.arange(int(tree.level[-1]) + 2))
    for a, b in zip(borders[:-1], borders[1:]):
        asked = np.arange(a, b) if a == 0 else a + np.flatnonzero(open_[tree.parent[a:b]])
        if not len(asked):
            continue
        found = distances(points[tree.centre[asked]], book)
        best = found.argmin(1)
        nearest = np.sqrt(found[np.arange(len(asked)), best].astype(np.float64))
        found[np.arange(len(asked)), best] = np.iinfo(np.int64).max
        second = np.sqrt(found.min(1).astype(np.float64))
        sure = (tree.radius[asked] == 0) | (second - nearest > 2 * tree.radius[asked] + 1e-9 * (second + 1))
        given[asked[sure]] = best[sure]
        open_[asked[~sure]] = True
    single = np.flatnonzero(open_[tree.leaf])
    return given, single, distances(points[single], book).argmin(1) if len(single) else np.empty(0, np.int64)


def codes_of(tree: Tree, points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of every point."""
    given, single, entries = assign(tree, points, book)
    borders = np.searchsorted(tree.level, np.arange(int(tree.level[-1]) + 2))
    for a, b in zip(borders[1:-1], borders[2:]):
        above = given[tree.parent[a:b]]
        given[a:b] = np.where(above >= 0, above, given[a:b])
    codes = given[tree.leaf]
    codes[single] = entries
    return codes


@dataclass
class Codes:
    """``rows``: id, carried columns, ``code`` (a byte a part) and ``error``; ``codebooks``: parts x entries x components."""

    rows: DataFrame
    codebooks: np.ndarray


def usable(vectors: DataFrame, id_col: str, vector_col: str, carry: tuple[str, ...]) -> DataFrame:
    """``id, vector`` and the carried columns as a struct, of the rows with finite vectors."""
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.struct(F.lit(True).alias("none"))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), carried.alias("carried"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & whole)


def _integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * vectors), -LIMIT, LIMIT).astype(np.int64)


def _packed_schema(rows: DataFrame) -> T.StructType:
    fields = [T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("carried", T.ArrayType(rows.schema["carried"].dataType)), T.StructField("points", T.BinaryType())]
    tree = T.StructType([T.StructField(n, T.BinaryType()) for n in Tree.FIELDS])
    return T.StructType([*fields, T.StructField("trees", T.ArrayType(tree))])


def pack(rows: DataFrame, dim: int, parts: int, scale: int = SCALE, chunk: int = CHUNK) -> DataFrame:
    """Chunks of vectors with a tree for each part: ``ids, carried, points, trees``."""
    most = max(LEAF, chunk // dim)
    tree_type = pa.list_(pa.struct([(n, pa.binary()) for n in Tree.FIELDS]))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), most):
                piece = batch.slice(at, most)
                if n + len(piece) > most:
                    yield _chunk(held)
                    held, n = [], 0
                held.append(piece)
                n += len(piece)
        if held:
            yield _chunk(held)

    def _chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, vectors, carried = (table[c].combine_chunks() for c in ("id", "vector", "carried"))
        points = _integers(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
        trees = [cover_tree(part).packed() for part in _parts(points, parts)]
        one = pa.array([0, len(points)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, carried), pa.array([points.astype(np.int32).tobytes()], pa.binary()),
                                           pa.array([trees], tree_type)], ["ids", "carried", "points", "trees"])

    return rows.mapInArrow(chunks, _packed_schema(rows))


def _parts(points: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(points, parts, axis=1)]


def _chunk_parts(batch: pa.RecordBatch, dim: int, parts: int) -> Iterator[tuple[int, list[tuple[Tree, np.ndarray]]]]:
    """Row number of each chunk, and its parts as trees and points."""
    for i in range(len(batch)):
        points = np.frombuffer(batch.column("points")[i].as_py(), np.int32).reshape(-1, dim).astype(np.int64)
        yield i, list(zip(map(Tree.unpacked, batch.column("trees")[i].as_py()), _parts(points, parts)))


def lloyd_round(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry the floored mean of its parts, an unused one as before."""
    parts, entries, width = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, width + 1), np.int64)  # sums, then the count
        for batch in batches:
            for _, pieces in _chunk_parts(batch, parts * width, parts):
                for k, (tree, points) in enumerate(pieces):
                    given, single, found = assign(tree, points, books[k])
                    sure = given >= 0
                    np.add.at(totals[k], given[sure], np.column_stack([tree.sums[sure], tree.counts[sure]]))
                    np.add.at(totals[k], found, np.column_stack([points[single], np.ones(len(single), np.int64)]))
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals.ravel()[used])], ["place", "total"])

    totals = np.zeros(parts * entries * (width + 1), np.int64)
    for row in packed.select("points", "trees").mapInArrow(partial, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        totals[row.place] = row.total
    totals = totals.reshape(parts, entries, width + 1)
    counts = totals[:, :, -1:]
    return np.where(counts > 0, totals[:, :, :-1] // np.maximum(counts, 1), books)


def code(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, carried, code, error`` of every packed vector."""
    parts, _, width = books.shape
    schema = T.StructType([T.StructField("id", packed.schema["ids"].dataType.elementType), T.StructField("carried", packed.schema["carried"].dataType.elementType),
                           T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, pieces in _chunk_parts(batch, parts * width, parts):
                found = np.stack([codes_of(tree, points, books[k]) for k, (tree, points) in enumerate(pieces)], axis=1)
                error = sum(((points - books[k][found[:, k]]) ** 2).sum(1) for k, (_, points) in enumerate(pieces))
                packed_codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(found), [None, pa.py_buffer(found.astype(np.uint8).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("carried")[i].values, packed_codes, pa.array(error)], ["id", "carried", "code", "error"])

    return packed.mapInArrow(coded, schema)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE, chunk: int = CHUNK) -> Codes:
    """Fit the codebooks on all vectors and code each; at most 256 entries, a byte each."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    rows = usable(vectors, id_col, vector_col, carry)
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = lengths[0].dim if lengths else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("vector") == dim)
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = _integers(np.array([r.vector for r in first], np.float64).reshape(-1, parts, dim // parts), scale).transpose(1, 0, 2)
    packed = written(pack(rows, dim, parts, scale, chunk), "packed")
    for _ in range(rounds if first else 0):
        books = lloyd_round(packed, books)
    coded = written(code(packed, books), "coded")
    return Codes(coded.select(F.col("id").alias(id_col), *[F.col("carried").getField(c).alias(c) for c in carry], "code", "error"), books)


def with_group_error(coded: DataFrame, group_col: str, name: str = "group_error") -> DataFrame:
    """The error summed over rows of equal ``group_col`` (nulls together) next to each row.

    The sums are made with partials in every task; they are broadcast if counted to be few, else both sides shuffle.
    """
    sums = written(coded.groupBy(F.col(f"`{group_col}`").alias("_group")).agg(F.sum("error").alias(name)), "group-errors")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return coded.join(sums, coded[f"`{group_col}`"].eqNullSafe(sums["_group"])).drop("_group")
