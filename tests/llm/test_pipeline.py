import corpus_pipeline
from leadweave.llm.common import written
from tests.llm.cases import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    """Planted cases go, clean documents stay, and every stage but the last returns the columns of documents."""
    item = prose(99, 40)
    clean = {i: f"{prose(i, 80)}.\n{prose(1000 + i, 60)}." for i in range(1, 41)}
    texts = clean | {101: clean[1], 102: " ".join(clean[2].replace("\n", " ").split()[:-2]), 103: f"{prose(103)}\n{item}\n{prose(104)}", 104: " ".join(f"{w}%%%" for w in prose(105, 150).split()), 105: "word " * 200, 106: None}
    rows = [(d, t, "en", f"s{d % 3}" if d != 7 else None, len(t or "")) for d, t in texts.items()]
    rows.append(rows[4])  # a repeated row: it loses its lines to none, and stays once
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 30)] + [(104, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert place != 2 or docs.count() == docs.distinct().count()
        kept.append({r.doc_id: r.text for r in docs.collect()})
        if place < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert set(kept[0]) == set(texts) - {104, 105, 106}
    assert set(kept[1]) == set(kept[0]) - {101}
    assert set(kept[2]) == set(kept[1]) - {102}
    assert set(kept[3]) == set(clean) and all(kept[3][d] == t for d, t in clean.items())
    total, taken = sum(len(t.split()) for t in clean.values()), sum(len(r.text.split()) for r in docs.collect())
    assert abs(taken - 1.5 * total) < 300 and {r["copy"] for r in docs.collect()} <= {1, 2}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_copies_of_one_id_are_told_apart(spark):
    """A clean text stays though a near copy has its id; of two linked texts of one id, or without an id, one stays."""
    base = {n: prose(n, 80) for n in range(1, 6)}
    copy = {n: f"{t} end" for n, t in base.items()}
    rows = [(1, base[1]), (2, copy[1]), (2, base[2]), (3, base[3]), (3, copy[3]), (None, base[4]), (None, copy[4]), (None, copy[1]), (4, base[5]), (4, base[5]), (None, None), (None, None)]
    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sum(d == 3 for d, _ in kept) == 1 and sum(t in (base[4], copy[4]) for _, t in kept) == 1
    assert sorted((d, t) for d, t in kept if d in (1, 2, 4)) == [(1, base[1]), (2, base[2]), (4, base[5])]
    assert len(kept) == 7 and kept.count((None, None)) == 2
