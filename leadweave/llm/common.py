"""What several text operators share: word and line rules, row packing, and joins whose small side is checked."""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.session import write_once

SPACES = " \t\n\x0b\x0c\r"  # the class [\x20\x09-\x0D]; the same bytes that bytes.split() and bytes.strip() take
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
# a side of at most so many narrow rows may be broadcast; beyond it the join shuffles
BROADCAST_ROWS = 1_000_000


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    text = F.col(text) if isinstance(text, str) else text
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def packed(rows: DataFrame, **inputs: str) -> DataFrame:
    """The whole row as one struct ``row``, next to the named inputs: columns of any other name can't clash with an operator's own."""
    return rows.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").alias(name) for name, c in inputs.items()])


def unpacked(rows: DataFrame, row: DataFrame, **results: Column) -> DataFrame:
    """The columns of ``row`` again, then the results; a result replaces an input column of its name."""
    kept = [F.col("row").getField(c).alias(c) for c in row.columns if c not in results]
    return rows.select(*kept, *[c.alias(n) for n, c in results.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and go on from there."""
    return write_once(df, f"llm-{name}")


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0x9E6C63D0876A9A45
_PIECE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _base_powers(n: int) -> list[np.ndarray]:
    """The first powers of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            grown = np.full(2 * n, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between bytes of [\\x20\\x09-\\x0D], in order: polynomials by prefix sums, a piece at a time."""
    found, at = [], 0
    while at < len(data):
        border = _SPACE.search(data, at + _PIECE)
        end = border.start() if border else len(data)
        piece = np.frombuffer(data, np.uint8, end - at, at)
        at = end
        base, inverse = _base_powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[piece] * base[:len(piece)], out=sums[1:])
        space = np.ones(len(piece) + 2, bool)
        space[1:-1] = _IS_SPACE[piece]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:])[:], np.flatnonzero(~space[:-1] & space[1:])
        found.append(mixed((sums[ends] - sums[starts]) * inverse[starts]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window of ``width`` words, in order; none if there are fewer words."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= _STEP
        out += words[i:i + n]
    return mixed(out)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of the text with A-Z lowered; a shorter text is one shingle, no word none."""
    words = word_hashes((text or "").encode().lower())
    if not len(words):
        return np.empty(0, np.uint64)
    found = window_hashes(words, min(width, len(words)))
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]
