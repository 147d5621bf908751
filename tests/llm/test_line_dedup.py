import hashlib

from pyspark.sql import functions as F

from leadweave.llm import line_dedup
from tests.llm.cases import odd_docs, unchanged

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    last = (1, 0)
    rank = lambda d: last if d is None else (0, d)
    owner = {}
    for d, t in rows:
        for k in map(key, (t or "").split("\n")):
            owner[k] = min(owner.get(k, (2, 0)), rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == rank(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def check(spark, docs):
    got = line_dedup.dedup_lines(docs)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute(rows)
    return got


def test_odd_rows(spark):
    docs = odd_docs(spark)
    unchanged(check(spark, docs), docs, "text", "n_lines", "n_dropped")
    assert check(spark, docs.limit(0)).count() == 0


def test_case_spaces_and_non_ascii(spark):
    docs = spark.createDataFrame([(2, "\x0b  Ärger mit ZEILEN \r\nx\n\xa0nbsp is no space here"), (1, "Ärger mit zeilen\nnbsp is no space here\n"), (3, "ärger mit zeilen")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in check(spark, docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_hot_line_takes_its_own_way(spark):
    docs = spark.range(1, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line everywhere\nline number "), "id", F.lit("\nsecond copy "), F.col("id") % 7).alias("text"))
    got = check(spark, docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == 2998 + 2999 - 7


def test_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(1, "aaaaaaaaaaaa\nbbbbbbbbbbbb"), (2, "aaaaaaaaaaaa\nshort\nbbbbbbbbbbbb\naaaaaaaaaaaa\nnew line here")], "doc long, text string")
    got = line_dedup.keep_bitmaps(docs).collect()
    assert [(r.doc, r.n_dropped, [(x.start, x.end) for x in r.kept_runs]) for r in got] == [(2, 3, [(1, 2), (4, None)])]
    assert hashlib.sha256(b"short\nnew line here").hexdigest() in {r.h for r in line_dedup.dedup_lines(docs, "doc").select(F.sha2("text", 256).alias("h")).collect()}
