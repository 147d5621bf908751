import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadweave.llm import resample as r
from tests.llm.cases import odd_docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def buckets(text, n_max=1, size=r.BUCKETS):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i:i + n]).encode()) % size for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aBz09 -é€/", max_size=90), max_size=5), st.integers(1, 3))
def test_features(texts, n_max):
    parts = [t.encode() for t in texts]
    borders = np.cumsum([0, *map(len, parts)])
    bucket, row, words = r.features(np.frombuffer(b"".join(parts), np.uint8), borders, 1000, n_max)
    for i, t in enumerate(texts):
        assert sorted(bucket[row == i].tolist()) == sorted(buckets(t, n_max, 1000))
        assert words[i] == len(WORD.findall(t.translate(LOWER)))


def brute(docs, target, share, min_words):
    s, t = np.zeros(r.BUCKETS, int), np.zeros(r.BUCKETS, int)
    found = [buckets(x) for _, x in docs]
    for b in found:
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, buckets(x), 1)
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + r.BUCKETS) / ((int(a) + 1) * (int(t.sum()) + r.BUCKETS)))) for a, b in zip(s, t)]
    rows = []
    for (doc, _), b in zip(docs, found):
        weight = sum(gain[i] for i in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    fit = sorted((x for x in rows if x[1] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return rows, fit[:share * len(fit) // 100]


def as_text(rows):
    return sorted(map(str, rows))


def test_against_brute_force(spark):
    docs = [(i, prose(i % 150, 15 + i % 40)) for i in range(400)]
    target = [prose(i, 30) for i in range(0, 30, 3)]
    frame, wanted = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string")
    rows, drawn = brute(docs, target, 10, 20)
    ranks = {x[0]: i + 1 for i, x in enumerate(drawn)}
    for chunk, finish in ((1 << 20, 1 << 14), (16, 2), (3, 1)):  # sorted at once; many rounds
        got = r.resample(frame, wanted, chunk=chunk, finish=finish)
        assert as_text(got.select("doc", "n_features", "weight", "score", "rank").toLocalIterator()) == as_text(
            [f"Row(doc={d}, n_features={n}, weight={w}, score={s}, rank={ranks.get(d)})" for d, n, w, s in rows])
    everything = r.resample(frame, wanted, share=100, chunk=16, finish=2)
    assert sorted(x.rank for x in everything.filter("rank IS NOT NULL").collect()) == list(range(1, sum(n >= 20 for _, n, _, _ in rows) + 1))


def test_odd_rows(spark):
    docs = odd_docs(spark, extra=[(None, prose(70, 40))] * 3 + [(50, prose(71, 40))] * 4)
    target = spark.createDataFrame([(prose(70, 40),), (None,), ("",)], "text string")
    listed = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    rows, drawn = brute(listed, [prose(70, 40)], 50, 20)
    got = r.resample(docs, target, share=50, chunk=2, finish=1).collect()
    assert as_text([(x.doc, x.n_features, x.weight, x.score) for x in got]) == as_text(rows)
    ranked = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, len(drawn) + 1))
    assert [(x.doc, x.score) for x in ranked] == [(x[0], x[3]) for x in drawn]
    nothing = spark.createDataFrame([], "text string")
    assert r.resample(docs, nothing).count() == len(listed) and r.resample(docs.limit(0), target).count() == 0


def test_pivot_leaves_a_quarter_on_each_side():
    key = lambda s, n: {"side": 0, "score": s, "no_id": False, "doc": s, "tie": 0, "row": s, "n": n}
    medians = [key(s, 1 + s % 5) for s in range(60)]
    pivot = r._pivot(medians)
    total = sum(m["n"] for m in medians)
    assert sum(m["n"] for m in medians if m["score"] >= pivot["score"]) * 2 >= total <= 2 * sum(m["n"] for m in medians if m["score"] <= pivot["score"])
