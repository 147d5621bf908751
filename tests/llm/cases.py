"""Rows that every operator has to bear: nulls, empty and long texts, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, source string, row string, doc string, version long, n_lines string, copies int, kept string, licenses string"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_docs(spark, extra=()):
    shared = "a line that several documents hold"
    texts = [(1, f"{prose(1)}\n{shared}"), (2, f"{shared}\n{prose(2)}"), (2, f"{shared}\n{prose(2)}"), (3, None), (4, ""), (5, " \n\t\n "), (None, f"{prose(6)}\n{shared}"),
             (7, f"{shared}\n{shared}\n{prose(7, 30000)}"), (8, prose(8).upper()), (9, prose(8)), (10, "one two three"), (11, "One two\tthree"), (2, "other text, same id"), *extra]
    rows = [(d, t, None if i % 3 == 0 else f"s{i % 2}", "x", "y", i, "z", 1, "k", "l") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def unchanged(df, docs, *results):
    """The input columns that are not results are the same rows as before."""
    names = [c for c in docs.columns if c not in results]
    order = lambda frame: sorted(map(str, frame.select(*names).collect()))
    assert order(df) == order(docs)
