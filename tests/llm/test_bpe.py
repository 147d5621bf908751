import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadweave.llm import bpe
from tests.llm.cases import odd_docs, prose, unchanged

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(FILE)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


def agrees(encoder, texts):
    got = [ids.tolist() for ids in encoder.encode(texts)]
    assert got == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    tokens = np.array(encoder.v.tokens, dtype=object)
    assert [bpe._joined(tokens, np.array(ids)) for ids in got] == [LIBRARY.decode(ids, skip_special_tokens=False) for ids in got]


def test_edges(encoder):
    agrees(encoder, [None, "", " \n\t", "a", "aaaa" * 99, "Don't 'S 'll''ve we'D", "x<|endoftext|>Y<|startoftext|> <|endoftext|><|endoftext|", "<|ENDOFTEXT|>",
                     "ΑΣ ΣΑ İstanbul", "a\x1cb\x85c d　e", "é é", "12 345 ½Ⅷ", "\U00016ea0\U00010d50 Ɤ", "x\x00y"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, text):
    agrees(encoder, [text])


def test_many_words_and_long_ones(encoder):
    rng = random.Random(5)
    words = ["".join(rng.choice("theandiourél") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    agrees(encoder, [" ".join(words), "a" * 9001, "".join(rng.choice("abcdefgh") for _ in range(bpe.LONG * 3)), "ab" * bpe.LONG + " end"])


def test_character_classes(encoder):
    """Every code point between letters and digits, many to a text."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000][::7]
    agrees(encoder, [" ".join(f"a{chr(c)}a1{chr(c)}" for c in points[i:i + 4000]) for i in range(0, len(points), 4000)])


def test_memory_of_words_is_let_go(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_IDS", 50)
    monkeypatch.setattr(bpe, "PIECE", 200)
    agrees(bpe.Encoder(vocabulary), [prose(i, 30) for i in range(20)] * 2)


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_operator(spark):
    docs = odd_docs(spark).withColumn("ids", F.lit("clashes")).withColumn("decoded", F.lit(1))
    apart, packed = bpe.decode(bpe.encode(docs, FILE), FILE), bpe.encode_packed(docs, FILE)
    unchanged(apart, docs, "ids", "decoded")
    unchanged(packed, docs, "packed_ids", "decoded")
    read = {(r.doc_id, r.text): r for r in packed.collect()}
    for r in apart.collect():
        want = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
        assert read[r.doc_id, r.text].packed_ids == struct.pack(f"<{len(want)}I", *want) and read[r.doc_id, r.text].decoded == r.decoded
    assert bpe.encode(docs.limit(0), FILE).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0, None, -4, 10 ** 6, 1])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, FILE).orderBy("doc_id").collect()] == ["", "", "! \""]
