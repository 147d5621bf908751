"""Byte-pair encoding and decoding by batched NumPy merge rounds.

A tokenizer file of the kind "split by a pattern, bytes as characters, merges with a mark at the word's end" is read once on the
driver, checked, and sent to the tasks as a few sorted arrays (``Vocabulary``, about 2 MB for 49,000 tokens). A task cuts its texts
into words and encodes the words it has not met yet together: their symbols lie in one flat array, every neighbouring pair is looked
up by binary search among the sorted pair keys, and each round merges, in every word at once, all pairs of that word's lowest rank.
As a merge's parts are always made by earlier merges (checked when the file is read), a word's lowest rank only rises, so merging all
places of one rank together gives what merging them one by one from the left gives. Words above ``LONG`` symbols keep their
pairs by rank instead and look at the places of a merge only, so a text of a million letters without a blank costs its length, not its
length times its rounds. Nothing crosses rows: no shuffle, and a lost task is simply run again.

Texts are processed whole. Added tokens are found first, in the text as given, and become their ids. The rest is composed (NFC),
lowered character by character and cut by the file's pattern; white space and nothing else falls out. Ids decode to the tokens'
strings joined by one blank, as a file without decoder asks; decoding keeps added tokens.

Defined cases: null and empty texts have no id (an empty array) and decode to the empty text. Repeated rows are encoded each. An id
that is not in the vocabulary, or null, decodes to nothing, as do null arrays. An empty table gives an empty one. Input columns named
like a result are replaced by it, all others stay. Character tables are those of Unicode 16, which the tokenizer library holds; letters
added later count as marks (``NEWER``). Compositions and mark orders that Python's own Unicode tables lack are not applied.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LONG = 4096          # symbols; a longer word is merged on its own
PIECE = 1 << 20      # characters whose words are looked up together
MEMO_IDS = 1 << 19   # ids of known words a task keeps; beyond it, it starts anew
_NONE = np.iinfo(np.int32).max
# fixed values: white space; lower cases of Unicode 16 and 17 that Python 3.13 does not know; letters and digits newer than Unicode 16
SPACE = "9-d 20 85 a0 1680 2000-200a 2028 2029 202f 205f 3000"
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 "
    "11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 "
    "1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead "
    "323b0-33479 3d000-3fc3f"
)


def _class(ranges: str) -> str:
    """Code points and ranges in hexadecimal as the inside of a character class."""
    return "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in ranges.split())


_SPACE, _NEWER = _class(SPACE), _class(NEWER)
# the file's steps that this module carries out
NORMALIZERS, PRETOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """What the tasks need of a tokenizer file: byte symbols, sorted pair keys with rank and result, token strings, the pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, steps = file["model"], lambda part: [s["type"] for s in (part or {}).get("normalizers", (part or {}).get("pretokenizers", []))]
        split = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if (model["type"] != "BPE" or steps(file["normalizer"]) != NORMALIZERS or steps(file["pre_tokenizer"]) != PRETOKENIZERS or file["decoder"] or model["continuing_subword_prefix"]
                or not (split["behavior"] == "Removed" and split["invert"]) or file["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] or model.get("ignore_merges") or model["dropout"]):
            raise ValueError(f"{path} is not a tokenizer of the kind this module encodes")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError(f"{path} has added tokens that match more than their own text")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = 1 + max([*vocab.values(), *[t["id"] for t in file["added_tokens"]]])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pattern = split["pattern"]["Regex"]
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_characters()], np.int32)
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        made = np.full(self.size, -1)
        made[pairs[::-1, 2]] = np.arange(len(pairs))[::-1]
        if (np.maximum(made[pairs[:, 0]], made[pairs[:, 1]]) >= np.arange(len(pairs))).any() or len(np.unique(pairs[:, 2])) < len(pairs):
            raise ValueError(f"{path} merges tokens before they are made, or makes one in two ways")
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int32), pairs[order, 2].astype(np.int32)
        self.result_of_rank = pairs[:, 2].astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``_NONE`` where they never merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of neighbouring hits the first, third and so on: x x x merges its first two."""
    place = np.arange(len(hit))
    start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
    return hit & ((place - start) % 2 == 0)


def merge_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each word has; every word has a byte at least."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = v.inner[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.cumsum(lengths)
    ids[ends - 1] = v.last[np.fromiter((w[-1] for w in words), np.uint8, len(words))]
    owner = np.repeat(np.arange(len(words)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank = np.full(len(ids), _NONE, np.int32)  # of the pair that begins here; a word's last symbol begins none
    rank[:-1] = v.rank(ids[:-1], ids[1:])
    rank[ends - 1] = _NONE
    for word in np.flatnonzero(lengths > LONG):
        part = _merge_long(v, ids[ends[word] - lengths[word]:ends[word]])
        done.append((np.full(len(part), word), part))
    mine = lengths[owner] <= LONG
    ids, owner, rank = ids[mine], owner[mine], rank[mine]
    while len(ids):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        counts = np.diff(np.append(first, len(ids)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), counts)
        over = lowest == _NONE
        if over.any():
            done.append((owner[over], ids[over]))
            ids, owner, rank, lowest = ids[~over], owner[~over], rank[~over], lowest[~over]
        hit = _every_other(rank == lowest)
        ids[hit] = v.result_of_rank[rank[hit]]
        stays = np.concatenate([[True], ~hit[:-1]])[:len(ids)]
        ids, owner, hit = ids[stays], owner[stays], hit[stays]
        rank = rank[stays]
        new = np.flatnonzero(hit | np.append(hit[1:], False))
        inside = new[(new + 1 < len(ids))]
        inside = inside[owner[inside] == owner[inside + 1]]
        rank[new] = _NONE
        rank[inside] = v.rank(ids[inside], ids[inside + 1])
    owners, found = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64), np.empty(0, np.int32))
    order = np.argsort(owners, kind="stable")
    return found[order], np.bincount(owners, minlength=len(words))


def _merge_long(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """One long word: the places of each rank wait in a list; after a merge only its two neighbouring pairs are looked up."""
    n, ids = len(ids), ids.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive, rank = np.ones(n, bool), np.full(n, _NONE, np.int32)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def look_up(places: np.ndarray) -> None:
        places = places[places >= 0]
        paired = after[places] < n
        rank[places[~paired]] = _NONE
        places = places[paired]
        rank[places] = v.rank(ids[places], ids[after[places]])
        places = places[rank[places] != _NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        for group in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1) if len(places) else []:
            r = int(rank[group[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(group)

    look_up(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
        start = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = after[at]
        ids[at] = v.result_of_rank[r]
        alive[gone] = False
        after[at] = after[gone]
        follows = at[after[at] < n]
        before[after[follows]] = follows
        look_up(np.unique(np.concatenate([at, before[at]])))
    return ids[alive]


class Encoder:
    """Encodes the texts of one task; keeps the ids of words it has met."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        source = v.pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"\s", _SPACE)
        self.ascii = re.compile(source.replace(r"\p{L}+", "[a-z]+").replace(r"\p{L}", "a-z").replace("|\\p{N}|", "|[0-9]|").replace(r"\p{N}", "0-9"))
        self.plain = regex.compile(source)
        without = source.replace(rf"[^{_SPACE}\p{{L}}\p{{N}}]", rf"(?:[^{_SPACE}\p{{L}}\p{{N}}]|[{_NEWER}])")
        self.careful = regex.compile("".join(rf"(?:(?![{_NEWER}])\p{{{x[3]}}})" if x.startswith(r"\p{") else x for x in re.split(r"(\[\^.*?\]|\\p\{[LN]\})", without)))
        self.rare = re.compile("[^\x00-\u0557\u2010-\u2027]")  # a quick look before the two long classes
        self.newer = re.compile(f"[{_NEWER}]")
        self.later = re.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")
        self.forget()

    def forget(self) -> None:
        """Begin with the added tokens only; they are known by number, so no word of a text can be taken for one."""
        self.memo: dict = {i: n for n, i in enumerate(self.v.added.values())}
        self.ids = np.array(list(self.v.added.values()), np.int32)
        self.starts, self.counts = np.arange(len(self.ids)), np.ones(len(self.ids), np.int64)

    def words(self, text: str | None) -> list:
        """The words of a text as they are merged; an added token as its id."""
        out: list = []
        for i, part in enumerate(self.added.split(text or "") if self.added else [text or ""]):
            if i % 2:
                out.append(self.v.added[part])
                continue
            if part.isascii():
                out += self.ascii.findall(part.lower())
                continue
            part = unicodedata.normalize("NFC", part)
            rare = self.rare.search(part)
            if rare:
                part = self.later.sub(lambda m: chr(LATER_LOWER[ord(m[0])]), part)
            part = part.replace("\u03a3", "\u03c3").lower()  # no final sigma: each character on its own
            out += (self.careful if rare and self.newer.search(part) else self.plain).findall(part)
        return out

    def learn(self, words: list[str]) -> None:
        ids, counts = merge_words(self.v, [w.encode("utf-8", "surrogatepass") for w in words])
        self.memo.update(zip(words, range(len(self.counts), len(self.counts) + len(words))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for piece in _pieces(texts):
            cut = [self.words(t) for t in piece]
            if len(self.ids) > MEMO_IDS:
                self.forget()
            new = sorted(set(chain.from_iterable(cut)) - self.memo.keys())
            if new:
                self.learn(new)
            for words in cut:
                at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
                counts = self.counts[at]
                ends = np.cumsum(counts)
                yield self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


def _pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    piece, held = [], 0
    for text in texts:
        piece.append(text)
        held += len(text or "")
        if held >= PIECE:
            yield piece
            piece, held = [], 0
    yield piece


def _with(rows: DataFrame, column: str, results: dict[str, str], make) -> DataFrame:
    """The rows with result columns made from one column, a piece of a batch at a time; a result replaces a column of its name.

    ``make`` is called once a task and gives a function from some values of the column to Arrow arrays.
    """
    kept = [c for c in rows.columns if c not in results]
    read = rows.select(*[F.col(f"`{c}`") for c in kept], *([] if column in kept else [F.col(f"`{column}`")]))
    at = kept.index(column) if column in kept else len(kept)
    schema = StructType([*[rows.schema[c] for c in kept], *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in results.items()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_values = make()
        for batch in batches:
            for first, last in _slices(batch.column(at)):
                piece = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*piece.columns[:len(kept)], *of_values(piece.column(at))], [*kept, *results])

    return read.mapInArrow(each, schema)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about ``PIECE`` bytes of text, or as many ids, together; a longer row is alone."""
    lengths = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(lengths.astype(np.int64)), 0
    while first < len(total):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PIECE, side="right")))
        yield first, last
        first = last


def _joined(tokens: np.ndarray, ids) -> str:
    if ids is None or not len(ids):
        return ""
    ids = np.asarray(ids, dtype=float)  # a null among the ids is no number
    known = (ids >= 0) & (ids < len(tokens))
    return " ".join(filter(None, tokens[ids[known].astype(np.int64)].tolist()))


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``ids`` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_file))  # to each executor once

    def make():
        encoder = Encoder(shared.value)
        return lambda texts: [_lists(list(encoder.encode(texts.to_pylist())))]

    return _with(docs, text_col, {"ids": "array<int>"}, make)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def decode(rows: DataFrame, tokenizer_file: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the text that their ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_file).tokens)

    def make():
        tokens = np.array(shared.value, dtype=object)
        return lambda lists: [pa.array([_joined(tokens, ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else None) for ids in lists], pa.string())]

    return _with(rows, ids_col, {"decoded": "string"}, make)


def encode_packed(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """The rows with ``packed_ids``, the ids as little-endian unsigned 32-bit integers as training files hold them, and ``decoded``, the text
    read back from those bytes; both by one pass of Python."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_file))

    def make():
        encoder, tokens = Encoder(shared.value), np.array(shared.value.tokens, dtype=object)

        def of_texts(texts: pa.Array) -> list[pa.Array]:
            packed = [ids.astype("<u4").tobytes() for ids in encoder.encode(texts.to_pylist())]
            return [pa.array(packed, pa.binary()), pa.array((_joined(tokens, np.frombuffer(b, "<u4")) for b in packed), pa.string())]

        return of_texts

    return _with(docs, text_col, {"packed_ids": "binary", "decoded": "string"}, make)
