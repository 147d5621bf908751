from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadweave.llm import quality_rules as q
from leadweave.llm.common import word_hashes
from tests.llm.cases import odd_docs, prose, unchanged

SPACES = " \t\n\x0b\x0c\r"


def counts(text):
    text = text or ""
    for c in SPACES[1:]:
        flat = text.replace(c, " ") if c == "\t" else flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #é\n\t\x0b |", max_size=60))
def test_counts(text):
    assert q.text_counts(text) == counts(text)
    assert len(word_hashes(text.encode())) == len(text.encode().split())


def score(texts, trusted, text):
    """The mean log ratio, counted in the open."""
    raw, good = Counter(), Counter()
    for t in texts:
        raw.update(q.ngram_buckets(t).tolist())
    for t in trusted:
        good.update(q.ngram_buckets(t).tolist())
    ratio = lambda b: np.log((good[b] + 1) / (sum(good.values()) + q.BUCKETS)) - np.log((raw[b] + 1) / (sum(raw.values()) + q.BUCKETS))
    found = q.ngram_buckets(text).tolist()
    return sum(map(ratio, found)) / len(found) if found else 0.0


def test_scores_and_threshold(spark):
    good = [(i, " ".join(prose(i % 9, 20) for _ in range(1)) + f" {prose(100 + i, 60)} and so on.") for i in range(24)]
    bad = [(100 + i, " ".join(f"{w}###" for w in prose(200 + i, 70).split())) for i in range(12)]
    docs = spark.createDataFrame(good + bad + [(900, None), (901, ""), (902, "x " * 40000), (None, good[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(100 + i, 0, 0) for i in range(6)] + [(13, 1, 1), (14, None, 0), (None, 1, 0), (0, 1, 0), (15, 1, None)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.text): r for r in q.judge_quality(docs, labels).collect()}
    texts, trusted = [r.text for r in docs.collect()], [t for i, t in good if i < 12 or i == 15]
    for (d, t), r in got.items():
        assert abs(r.score - score(texts, trusted, t)) < 1e-9
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (d is None or d < 100)
    few = q.labelled_sample(labels, 3).collect()
    assert sum(r.good for r in few) == 3 and sum(not r.good for r in few) == 3


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.judge_quality(docs, labels)
    unchanged(got, docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")
    assert all(r.score == 0 for r in got.collect()) and q.judge_quality(docs.limit(0), labels).count() == 0


def test_every_labelled_document_counts(spark):
    """All of 20,050 documents are trusted, so trusted and raw counts are the same and no word is better than another."""
    docs = spark.range(20_050).selectExpr("id AS doc_id", "concat('word', id) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert q.labelled_documents(labels).count() == 20_050
    assert q.judge_quality(docs, labels).filter("score <> 0").count() == 0
