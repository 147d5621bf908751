import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadweave.llm import parity_join as p
from leadweave.llm.common import shingle_set
from tests.llm.cases import odd_docs, prose


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j], assume_unique=True))
            if len(a) and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and both:
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(sets[i]), names.get(find(i)) if len(sets[i]) else d) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc, r.n_shingles, r.component) for r in p.near_duplicates(docs).collect()), key=str) == brute(rows)


def edited(words, n, rng):
    words = words[:]
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return words


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 400), st.integers(0, 10 ** 6), st.floats(0.8, 1))
def test_sets_that_link_share_keys(n, seed, similarity):
    """The pigeonhole over all sizes: sets at or above the similarity share enough keys of one deal, unless they are equal."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2 ** 63, 3 * n).astype(np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    most = int(2 * n * (1 - similarity) / (1 + similarity))
    gone = int(rng.integers(0, most + 1))
    a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[gone:n], pool[n:n + most - gone]]))
    both = len(np.intersect1d(a, b))
    if both < n and len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
        keys, owners = p.signature_keys([a, b])
        common = np.intersect1d(keys[owners == 0], keys[owners == 1])
        deals, times = np.unique(common & np.uint64(0xFF), return_counts=True)
        assert any(k >= p.SHARED[int(d) >> 1 & 3] for d, k in zip(deals, times))
        assert 9 * sum(bin(int(x)).count("1") for x in (p.sketch(a)[:1] ^ p.sketch(b)[:1]).view(np.uint64)) <= 9 * 64


def test_groups_chains_and_passages(spark):
    rng, rows = random.Random(5), []
    passage = prose(77, 60)
    base = prose(1, 200).split()
    rows += [(i, " ".join(edited(base, 3, rng))) for i in range(60)]  # near copies of one text
    rows += [(100 + i, f"{prose(300 + i, 70)} {passage}") for i in range(60)]  # one passage in different texts
    chain = prose(9, 150).split()
    for i in range(12):  # each one close to the next only
        chain = chain[4:] + prose(500 + i, 4).split()
        rows.append((200 + i, " ".join(chain)))
    rows += [(300 + i, " ".join(prose(i % 4 + 20, 6 + i % 3).split())) for i in range(12)]  # few words
    rng.shuffle(rows)
    small, p.SMALL_KEY = p.SMALL_KEY, 4  # so that keys are refined here too
    try:
        check(spark, rows)
    finally:
        p.SMALL_KEY = small


def test_odd_rows(spark):
    check(spark, [(r.doc_id, r.text) for r in odd_docs(spark, [(20, "a b"), (21, "A\x0bb"), (22, "b a")]).collect()])
    assert p.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_family_in_several_components_and_many_copies(spark, monkeypatch):
    """Near copies that mostly miss the similarity with each other, through rounds of pivots and through the pairs after them."""
    rng, rows = random.Random(8), []
    for family in range(3):
        base = prose(900 + family, 900).split()
        rows += [(1000 * family + i, " ".join(edited(base, rng.choice((4, 9, 14, 19)), rng))) for i in range(70)]
    shared = prose(950, 500).split()
    rows += [(5000 + i, " ".join(shared + prose(2000 + i, 120 + i).split())) for i in range(40)]  # one long passage, different ends
    rng.shuffle(rows)
    for pivots, rounds in ((4, 8), (1, 1)):
        monkeypatch.setattr(p, "PIVOTS", pivots)
        monkeypatch.setattr(p, "ROUNDS", rounds)
        check(spark, rows)
    copies = spark.range(10_000).selectExpr("id AS doc_id", f"CASE WHEN id % 5000 = 17 THEN concat('{rows[0][1]}', ' tail') ELSE '{rows[0][1]}' END AS text").repartition(5)
    assert {(r.component, r["count"]) for r in p.near_duplicates(copies).groupBy("component").count().collect()} == {(0, 10_000)}


def test_keys_of_three_sets_are_met_by_their_ends(spark, monkeypatch):
    """The smallest and largest node of a key have met all its sets: unlinked ones in keys of three leave no row for the rounds."""
    rng, base, left = random.Random(4), prose(31, 300).split(), []
    rows = [(i, " ".join(edited(base, 5, rng))) for i in range(3)]
    make = p.written

    def counted(df, name):
        made = make(df, name)
        left.extend([made.count()] if name in ("shared-keys", "open-keys") else [])
        return made

    monkeypatch.setattr(p, "written", counted)
    check(spark, rows)
    assert left[0] > 0 and left[1] == 0
