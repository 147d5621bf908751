import random

import numpy as np
import pytest

from leadweave.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, id int, vector int"


def brute(rows, parts, entries, rounds):
    """Ids, codes and errors by comparing everything with everything."""
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    x = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for last in [False] * rounds + [True]:
        apart = [((x[:, k, None] - books[k][None]) ** 2).sum(2) for k in range(parts)]
        codes = np.stack([a.argmin(1) for a in apart], 1)
        for k in range(0 if last else parts):
            for j in range(len(books[k])):
                mine = codes[:, k] == j
                if mine.any():
                    books[k, j] = x[mine, k].sum(0) // mine.sum()
    return [(r[0], bytes(c.astype(np.uint8)), int(e)) for r, c, e in zip(rows, codes, sum(a.min(1) for a in apart))], books


@pytest.mark.parametrize("n, dim, spread", [(1, 3, 5), (50, 1, 3), (400, 2, 40), (600, 4, 1000), (300, 8, 3), (200, 4, 0)])
def test_trees(n, dim, spread):
    rng = np.random.default_rng(n)
    points = rng.integers(-spread, spread + 1, (n, dim))
    points[n // 2:n // 2 + n // 4] = points[0]
    tree = v.cover_tree(points, 4)
    assert tree.counts[0] == n and (tree.sums[0] == points.sum(0)).all()
    for node in range(len(tree.level)):  # every node covers, counts and sums what lies below it
        below = np.zeros(n, bool)
        for i in range(n):
            at = tree.leaf[i]
            while at >= 0 and at != node:
                at = tree.parent[at]
            below[i] = at == node
        assert tree.counts[node] == below.sum() and (tree.sums[node] == points[below].sum(0)).all()
        assert (np.sqrt(((points[below] - points[tree.centre[node]]) ** 2).sum(1)) <= tree.radius[node] + 1e-9).all()
    again = v.Tree.unpacked(tree.packed())
    book = np.concatenate([points[:min(n, 9)], points[:2]])  # equal entries: the lower index wins
    assert (v.codes_of(again, points, book) == ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
    given, single, found = v.assign(tree, points, book)
    assert tree.counts[given >= 0].sum() + len(single) == n


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-5, 6, (500, 4)) + c for c in (0, 1000, -1000)])
    given, single, _ = v.assign(v.cover_tree(points), points, np.array([[0] * 4, [1000] * 4, [-1000] * 4]))
    assert (given >= 0).sum() <= 6 and not len(single)


def test_large_numbers_stay_exact():
    points, book = np.array([[v.LIMIT, -v.LIMIT]]), np.array([[-v.LIMIT, v.LIMIT], [v.LIMIT, 1 - v.LIMIT]])
    assert v.distances(points, book).tolist() == [[2 * (2 * v.LIMIT) ** 2, 1]]


@pytest.mark.parametrize("chunk", [1 << 18, 96])
def test_against_brute_force(spark, chunk):
    rng = random.Random(3)
    rows = [(i * 7 % 501, [rng.gauss(0, 0.3) for _ in range(8)], i % 5 or None) for i in range(500)]
    rows = [(i, np.array(x, np.float32).tolist(), label) for i, x, label in rows] + [(1000 + i, [0.25] * 8, 1) for i in range(300)]
    made = v.compress(spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(5), carry=("label",), parts=4, entries=16, chunk=chunk)
    want, books = brute(rows, 4, 16, 2)
    assert (made.codebooks == books).all()
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in made.rows.collect()) == want
    by_label = {}
    labels = {r[0]: r[2] for r in rows}
    for i, _, e in want:
        by_label[labels[i]] = by_label.get(labels[i], 0) + e
    got = v.with_group_error(made.rows, "label").collect()
    assert len(got) == 800 and all(r.group_error == by_label[r.label] for r in got)


def test_odd_rows(spark):
    rows = [(1, [0.5, 1.0], 1), (1, [0.5, 1.0], 1), (1, [0.25, 1.0], None), (None, [3.0, 4.0], None), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 0.0], 1),
            (5, [float("inf"), 0.0], 1), (6, [1.0, 2.0, 3.0], 1), (7, [], 1), (8, [-1e30, 1e30], 2)]
    vectors = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    made = v.compress(vectors, carry=("label",), parts=2, entries=4, rounds=1)
    got = made.rows.collect()
    assert sorted(map(str, (r.vec_id for r in got))) == ["1", "1", "1", "8", "None"] and made.codebooks.shape == (2, 4, 1)
    assert sum(r.error for r in got if r.vec_id == 1) == 0
    assert v.compress(vectors.limit(0), parts=2).rows.count() == 0
    with pytest.raises(ValueError):
        v.compress(vectors, parts=3)
