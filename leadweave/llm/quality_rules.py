"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, next to a few counted rules.

Texts are cut into runs of word characters and runs of marks; single tokens and pairs are hashed into ``BUCKETS`` buckets. One
multinomial is counted over the whole corpus, one over trusted documents. A document's score is the mean log ratio of its n-grams,
so length does not matter. The threshold lies half way between the mean scores of labelled good and labelled bad documents.

Every labelled document counts: the trusted counts and the threshold are fitted on all of them, the corpus counts on every document, and
every document is scored against the same threshold. A caller may fit on fewer labelled rows (``labelled_rows`` per class, those with the
smallest hash of their id). Up to ``BROADCAST_ROWS`` labelled ids are broadcast; more meet the documents by id.

Defined cases: null text has no word. A text without any n-gram scores 0. Documents without an id are scored, but not trusted. A
document labelled twice counts as bad or toxic if either label says so. Without trusted documents every score is 0; with no
labelled document on one side the threshold is ``FALLBACK``. An empty table gives an empty result. Input columns named like a result are
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import BROADCAST_ROWS, window_hashes, word_hashes, written

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS  # bounds what the counts send to the driver and the weights sent to the tasks
FALLBACK = -0.5
MIN_WORDS = 50
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the tokens and token pairs of the text in lower case, repeats included."""
    tokens = _TOKEN.findall((text or "").lower())
    single = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pairs = single[:-1] * _PAIR[0] + single[1:] * _PAIR[1]
    return (np.concatenate([single, pairs]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of a whole partition: all texts, and trusted ones."""
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, is_trusted in zip(batch.column(0), batch.column(1)):
            found = ngram_buckets(text.as_py())
            np.add.at(raw, found, 1)
            if is_trusted.as_py():
                np.add.at(trusted, found, 1)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(trusted[seen])], ["bucket", "raw", "trusted"])


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log of trusted over raw probability by bucket, with one added to every count; 0 without trusted text."""
    if not trusted.sum():
        return np.zeros(BUCKETS)
    return np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def labelled_documents(labels: DataFrame) -> DataFrame:
    """``labelled_id, good, trusted`` of every labelled document."""
    single = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(
        (F.min("quality") > 0).alias("good"), (F.max(F.coalesce("toxic", F.lit(0))) > 0).alias("toxic"))
    return single.select("labelled_id", "good", (F.col("good") & ~F.col("toxic")).alias("trusted"))


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` good and ``most`` bad ones of the labelled documents."""
    known = labelled_documents(labels)
    sides = [known.filter(F.col("good") == side).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most) for side in (True, False)]
    return sides[0].unionByName(sides[1])


def fit_ratios(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """Log ratios by bucket; ``docs`` is ``doc, text``, all of it is counted."""
    marked = docs.join(labelled.filter("trusted").select("labelled_id", "trusted"), F.col("doc") == F.col("labelled_id"), "left")
    counted = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(_count, "bucket long, raw long, trusted long")
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toLocalIterator():
        raw[row.bucket], trusted[row.bucket] = row.raw, row.trusted
    return log_ratios(raw, trusted)


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in three-word windows found twice or more."""
    text = text or ""
    hashes = word_hashes(text.encode())
    chars = len(text) - sum(map(text.count, _SPACES)) if len(hashes) else 0
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    repeated = 0
    windows = window_hashes(hashes, 3)
    if len(windows):
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[place] > 1)
        covered = np.zeros(len(hashes), bool)
        for offset in range(3):
            covered[starts + offset] = True
        repeated = int(covered.sum())
    return len(hashes), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated


def text_stats(ratios: np.ndarray):
    """Column function: the counts of a text and its score."""
    weights = ratios.astype(np.float64)

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    def stats(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = ngram_buckets(text)
            rows.append((*text_counts(text), float(weights[found].mean()) if len(found) else 0.0))
        return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return stats.asNondeterministic()  # else a filter on the result makes Spark run it twice


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def fit_threshold(docs: DataFrame, labelled: DataFrame, ratios: np.ndarray) -> float:
    """Half way between the mean scores of labelled good and bad documents that pass the counted rules."""
    known = docs.join(labelled, F.col("doc") == F.col("labelled_id")).select("good", text_stats(ratios)("text").alias("s"))
    means = {r.good: r.mean for r in known.filter(~base_failed("s")).groupBy("good").agg(F.avg("s.score").alias("mean")).collect()}
    return (means[True] + means[False]) / 2 if len(means) == 2 else FALLBACK


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` with the counts, ``score``, ``base_failed`` and ``kept``, fitted on every labelled row unless a number is given."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    labelled = written(labelled_documents(labels) if labelled_rows is None else labelled_sample(labels, labelled_rows), "labelled")
    if labelled.count() <= BROADCAST_ROWS:
        labelled = F.broadcast(labelled)
    ratios = fit_ratios(rows, labelled)
    threshold = fit_threshold(rows, labelled, ratios)
    judged = docs.select(F.struct("*").alias("row"), text_stats(ratios)(F.col(f"`{text_col}`")).alias("s"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
    results = {n: F.col(f"s.{n}") for n in names} | {"base_failed": base_failed("s"), "kept": ~base_failed("s") & (F.col("s.score") >= threshold)}
    return judged.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in results], *[c.alias(n) for n, c in results.items()])
