"""Importance resampling towards a target distribution: hashed features, array-scored weights, exact top share by median of medians.

Features are the runs of up to ``max_n`` words, hashed by crc32 into buckets; both corpora are counted by bucket in full, and a bucket's
gain is the floored log ratio of target to corpus with one added to every count. A document's weight is the floored mean gain of its
features, its score the weight plus Gumbel noise drawn from a hash of its id, so the highest scores are a sample without replacement in
proportion to exp(weight / 1000). Words, buckets and weights come from the Arrow buffers of whole batches: no Python code per word.

The cutoff key of the share to draw is found by weighted median-of-medians rounds over the written scores: every chunk of candidate
keys (a part of a partition, ``CHUNK`` keys at most) reports its median and size, the median of these weighted by size is the pivot, and
at least a quarter of the candidates lie on each side of it. The side that can't hold the cutoff is discarded. Each round is one scan that also
yields the medians of both sides for the next. At most ``FINISH`` remaining keys are sorted. The driver sees one row a chunk. Winners
are sorted by range and numbered by partition counts; no task holds them all.

Keys are (score down, id up, null ids last, text hash, row number in the written table), so no two rows share one: rows without id, ties
and repeated rows are drawn one by one. Defined cases: null and empty texts and texts without a word have no feature and weight 0. A null id is hashed as
the empty text. An empty corpus gives an empty result; an empty target counts 0 everywhere. Only the two named columns are read; other
columns, whatever their names, are not carried along (join by id).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import written

BUCKETS = 10_000
MIN_WORDS = 20
SHARE = 10            # per cent
SEED = "2024"
CHUNK = 1 << 20       # keys that one median stands for
FINISH = 1 << 14      # keys that are sorted at the end
PIECE = 1 << 22       # bytes of text cut at once
_LONG_WORD = 64       # bytes; longer ones are hashed one by one


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_BYTES = np.arange(256, dtype=np.uint8)
_IS_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES | 0x20 >= 0x61) & (_BYTES | 0x20 <= 0x7A) & (_BYTES < 0x80))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after the words' bytes: all words by one byte at a time, long words each at once."""
    state = state.copy()
    for i in np.flatnonzero(lengths > _LONG_WORD):
        state[i] = ~np.uint32(zlib.crc32(data[starts[i]:starts[i] + lengths[i]].tobytes(), int(~state[i])))
    order = np.flatnonzero(lengths <= _LONG_WORD)
    order = order[np.argsort(-lengths[order], kind="stable")]
    now, at, left = state[order], starts[order], lengths[order]
    longest = int(left[0]) if len(left) else 0
    reach = len(left) - np.searchsorted(left[::-1], np.arange(longest), side="right")
    for k in range(longest):
        m = reach[k]
        now[:m] = _CRC[(now[:m] ^ data[at[:m] + k]) & np.uint32(0xFF)] ^ (now[:m] >> np.uint32(8))
    state[order] = now
    return state


def features(data: np.ndarray, borders: np.ndarray, buckets: int = BUCKETS, max_n: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature of the rows ``data[borders[i]:borders[i + 1]]``, by row, and the rows' numbers of words."""
    data = _LOWER[data]
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    own = borders[:-1][np.diff(borders) > 0]  # a row's first byte begins a word even where the row before ends in one
    cut = own[inside[own + 1] & inside[own]]
    begins[cut] = ends[cut] = True
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) - starts
    rows = np.searchsorted(borders, starts, side="right") - 1
    state = _advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    found, owners = [state], [rows]
    for n in range(2, max_n + 1):  # each run goes on from the run that is one word shorter
        state = state[:-1]
        state = _CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = _advance(state, data, starts[n - 1:], lengths[n - 1:]) if len(state) else state
        whole = rows[n - 1:] == rows[:len(state)]
        found.append(state[whole])
        owners.append(rows[:len(state)][whole])
    bucket, owner = (~np.concatenate(found)).astype(np.int64) % buckets, np.concatenate(owners)
    if max_n > 1:
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
    return bucket, owner, np.bincount(rows, minlength=len(borders) - 1)


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some rows and their borders, about ``PIECE`` bytes at a time; a longer text comes whole and alone."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        yield data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def count_features(texts: DataFrame, buckets: int = BUCKETS, max_n: int = 1) -> np.ndarray:
    """Features by bucket over all rows of the one text column; a task sends its buckets only."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, borders in _texts(batch.column(0)):
                counts += np.bincount(features(data, borders, buckets, max_n)[0], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of both multinomials by bucket, one added to every count."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(h: int) -> int:
    """Floored Gumbel noise of a 32-bit hash, in thousandths."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, max_n: int = 1, seed: str = SEED) -> DataFrame:
    """``doc, n_words, n_features, weight, score, tie`` of every row of ``docs`` (``doc, text``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select("doc", h.alias("h"), F.xxhash64("text").alias("tie"), "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, sums = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for data, borders in _texts(batch.column(3)):
                bucket, owner, n_words = features(data, borders, len(gain), max_n)
                ends = np.searchsorted(owner, np.arange(len(borders) - 1), side="right")
                up_to = np.concatenate([[0], np.cumsum(gain[bucket])])[np.concatenate([[0], ends])]
                words.append(n_words)
                counts.append(np.diff(ends, prepend=0))
                sums.append(np.diff(up_to))
            n, total = np.concatenate(counts), np.concatenate(sums)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            scores = weight + np.fromiter(map(noise, batch.column(1).to_pylist()), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(n), pa.array(weight), pa.array(scores), batch.column(2)],
                                             ["doc", "n_words", "n_features", "weight", "score", "tie"])

    doc_type = docs.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc {doc_type}, n_words long, n_features long, weight long, score long, tie long")


KEY = ["score", "no_id", "doc", "tie", "row"]


def _before(key: dict, or_equal: bool = False) -> Column:
    """Whether a row comes before the key: highest score first, the rest ascending."""
    found = F.lit(or_equal)
    for name in reversed(KEY):
        c, v = F.col(name), F.lit(key[name])
        nearer = (c > v) if name == "score" else (c < v)
        found = F.coalesce(nearer, F.lit(False)) | (c.eqNullSafe(v) & found)
    return found


def _sorted(keys: pa.Table) -> pa.Table:
    return keys.take(pc.sort_indices(keys, sort_keys=[(n, "descending" if n == "score" else "ascending") for n in KEY], null_placement="at_end"))


def _medians(candidates: DataFrame, side: Column, chunk: int) -> list[dict]:
    """By chunk of a partition and side: number of keys and their lower median."""
    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= chunk:
                yield from _reports(held)
                held = []
        yield from _reports(held)

    found = candidates.select(side.alias("side"), *KEY)
    return [r.asDict() for r in found.mapInArrow(medians, found.schema.simpleString()[7:-1].replace(":", " ") + ", n long").collect()]


def _reports(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    keys = pa.Table.from_batches(held)
    for side in (0, 1, 2):
        part = keys.filter(pc.equal(keys["side"], side))
        if len(part):
            median = _sorted(part).slice((len(part) - 1) // 2, 1).combine_chunks()
            yield median.append_column("n", pa.array([len(part)], pa.int64())).to_batches()[0]


def _pivot(medians: list[dict]) -> dict:
    """The weighted median of medians."""
    table = _sorted(pa.Table.from_pylist(medians))
    upto = np.cumsum(table["n"].to_numpy())
    return table.slice(int(np.searchsorted(upto, (upto[-1] + 1) // 2)), 1).to_pylist()[0]


def cutoff_key(keys: DataFrame, wanted: int, chunk: int = CHUNK, finish: int = FINISH) -> dict:
    """The ``wanted``-th key (1 or more, at most their number) of a written table of keys."""
    candidates, side = keys, F.lit(0)
    medians = _medians(candidates, side, chunk)
    while sum(m["n"] for m in medians) > finish:
        pivot = _pivot(medians)
        # 0: before the pivot, 1: the pivot, 2: after it
        side = F.when(_before(pivot), 0).otherwise(F.when(_before(pivot, True), 1).otherwise(2))
        medians = _medians(candidates, side, chunk)
        ahead = sum(m["n"] for m in medians if m["side"] == 0)
        if wanted <= ahead:
            candidates, kept = candidates.filter((F.col("score") >= pivot["score"]) & _before(pivot)), 0
        elif wanted == ahead + 1:
            return pivot
        else:
            candidates, kept, wanted = candidates.filter((F.col("score") <= pivot["score"]) & ~_before(pivot, True)), 2, wanted - ahead - 1
        medians = [m for m in medians if m["side"] == kept]
    return candidates.select(*KEY).orderBy(F.desc("score"), *KEY[1:]).limit(wanted).collect()[-1].asDict()


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows sorted by ``order`` with ``rank`` 1, 2, 3...: written by range, then every range adds the sizes of those before it."""
    ranged = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", rank).drop("_part", "_start", "_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, max_n: int = 1, seed: str = SEED, chunk: int = CHUNK, finish: int = FINISH) -> DataFrame:
    """``doc, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null for documents that are not drawn.

    Of the documents with at least ``min_words`` words, ``share`` per cent (floored) are drawn.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    gain = gains(count_features(rows.select("text"), buckets, max_n), count_features(target.select(F.col(f"`{target_col}`").alias("text")), buckets, max_n))
    scored = written(score(rows, gain, max_n, seed).select("*", F.col("doc").isNull().alias("no_id"), F.monotonically_increasing_id().alias("row")), "scored")
    fit = scored.filter(F.col("n_words") >= min_words)
    wanted = share * fit.count() // 100
    results = ["doc", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*results, F.lit(None).cast("long").alias("rank"))
    last = cutoff_key(fit, wanted, chunk, finish)
    drawn = (F.col("n_words") >= min_words) & _before(last, True)
    ranked = numbered(scored.filter(drawn), F.desc("score"), *KEY[1:])
    return scored.filter(~drawn).select(*results, F.lit(None).cast("long").alias("rank")).unionByName(ranked.select(*results, "rank"))
