import random

import pytest
from pyspark.sql import functions as F

from leadweave.session import scratch_dir
from leadweave.sources.store import WRITES, fold_state, folded, lead_table, upsert_fold
from leadweave.sources.versioned import Conflict, VersionedTable
from leadweave.streaming import jobs
from tests.conftest import values


def writes(spark, first, last, urls=40):
    rng = random.Random(first)
    rows = []
    for seq in range(first, last):
        row = {f.name: rng.choice(["", f"{f.name}{seq}"]) for f in WRITES.fields}
        row |= {"seq": seq, "id": f"i{seq}", "source_url": f"u{rng.randint(0, urls)}", "source_domain": "d", "is_cis": rng.random() > 0.5, "mx_valid": True, "written_at": None}
        rows.append(tuple(row[f.name] for f in WRITES.fields))
    return spark.createDataFrame(rows, WRITES)


def listed(df):
    return sorted(map(str, df.collect()))


def keys_table(spark, buckets=8):
    return VersionedTable(spark, scratch_dir(spark, "table"), "k", lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), buckets)


def numbers(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("key-"), "id").alias("k"), F.col("id").alias("v"))


def test_commits_equal_one_fold(spark):
    table, whole = lead_table(spark, scratch_dir(spark, "leads"), buckets=8), writes(spark, 0, 300)
    for i, (a, b) in enumerate(((200, 300), (0, 100), (100, 200))):  # order doesn't matter
        part = whole.filter(F.col("seq").between(a, b - 1))
        assert table.commit(fold_state(part), "w", i) == i + 1
        assert table.commit(fold_state(part), "w", i) == i + 1  # a replay
    assert listed(folded(table.read())) == listed(upsert_fold(whole))
    assert listed(folded(table.read(version=1))) == listed(upsert_fold(whole.filter("seq >= 200")))
    table.vacuum(keep=1)
    assert listed(folded(table.read())) == listed(upsert_fold(whole)) and len(table._names("manifests")) == 1


def test_readers_see_whole_versions_when_a_commit_stops(spark, monkeypatch):
    table = keys_table(spark)
    table.commit(numbers(spark, 0, 50), "w", 0)
    before = listed(table.read())
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda self, made: (_ for _ in ()).throw(OSError("lost between the two writes")))
        with pytest.raises(OSError):
            table.commit(numbers(spark, 40, 90), "w", 1)
    assert listed(table.read()) == before and table.manifest().version == 1
    assert table.commit(numbers(spark, 40, 90), "w", 1) == 2 and table.read().count() == 90
    abandoned = len(table._names("state"))
    table.vacuum()
    assert len(table._names("state")) == abandoned - 1 and table.read().count() == 90


def test_only_touched_buckets_are_written_and_read(spark):
    table = keys_table(spark)
    table.commit(numbers(spark, 0, 200), "w", 0)
    first = table.manifest().buckets
    assert len(first) == 8
    table.commit(numbers(spark, 7, 8), "w", 1)
    second = table.manifest().buckets
    assert sum(first[b] != second[b] for b in first) == 1
    one = spark.createDataFrame([("key-7",)], "wanted string")
    found = table.lookup(one)
    assert values(found, "k", "v") == [("key-7", 7)]
    assert {f.rsplit("/", 2)[1] for f in found.inputFiles() if "/bucket=" in f} == {f"bucket={b}" for b in first if first[b] != second[b]}


def test_two_writers_at_once(spark, monkeypatch):
    table = keys_table(spark)
    other = VersionedTable(spark, table.path, "k", table.merge, 8)
    write, done = VersionedTable._write, []

    def slow(self, rows, folder):
        if self is table and not done:  # the other one is faster
            done.append(other.commit(numbers(spark, 100, 150), "b", 0))
        write(self, rows, folder)

    monkeypatch.setattr(VersionedTable, "_write", slow)
    assert table.commit(numbers(spark, 0, 120), "a", 0) == 2
    assert table.read().count() == 150 and table.manifest().writers == {"a": 0, "b": 0}
    with pytest.raises(Conflict):
        table._publish(table.manifest(1))


def test_unknown_keys_read_no_key_column(spark, monkeypatch):
    table = keys_table(spark)
    asked = spark.createDataFrame([(f"key-{i}", i, "x") for i in range(150)] + [(None, 0, "y"), ("key-0", 9, "z")], "k string, bucket int, row string")
    assert listed(table.unknown(asked, "k")) == listed(asked)
    table.commit(numbers(spark, 0, 100), "w", 0)
    assert listed(table.unknown(asked, "k")) == listed(asked.filter("k IS NULL OR (bucket >= 100)"))
    narrow = VersionedTable(spark, scratch_dir(spark, "table"), "k", table.merge, 2, 32_768)  # so full that bits are shared: still exact
    narrow.commit(numbers(spark, 0, 20_000), "w", 0)
    assert narrow.unknown(numbers(spark, 19_000, 22_000), "k").count() == 2_000
    monkeypatch.setattr(VersionedTable, "read", lambda *a, **k: pytest.fail("the table was read"))
    assert table.unknown(numbers(spark, 5_000, 5_040), "k").count() == 40


def test_single_keys_skip_row_groups(spark):
    table = keys_table(spark, 1)
    table.commit(numbers(spark, 0, 5_000), "w", 0)

    def scanned(key):
        df = table.read().filter(F.col("k") == key)
        n = df.count()
        leaf = df.filter("v >= 0")
        leaf.collect()
        plan = leaf._jdf.queryExecution().executedPlan()
        return n, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert scanned("key-4321")[0] == 1
    assert scanned("key-4321x") == (0, 0)  # within the range of keys, ruled out by the Bloom filter


def test_streams_on_tables(spark):
    incoming, out = scratch_dir(spark, "incoming"), scratch_dir(spark, "out")
    rows = spark.range(90).select(F.when(F.col("id") % 3 == 0, "Hot ").otherwise(F.concat(F.lit("k"), F.col("id") % 25)).alias("v"), "id")
    rows.repartition(4).write.parquet(incoming)
    table = jobs.seen_keys(spark, scratch_dir(spark, "seen"), 4)
    stream = jobs.stream_table(spark, incoming, rows.schema, 1)
    jobs.stream_first_seen_table(stream, "v", table, out, scratch_dir(spark, "state"), "w").awaitTermination()
    got = spark.read.option("basePath", out).parquet(f"{out}/writer=*/batch_id=*")
    want = {v.strip().lower() for v in values(rows, "v")}
    assert sorted(values(got, "norm")) == sorted(want) == sorted(values(table.read(), "norm"))
    # a stream that starts anew from the first batch finds everything committed
    jobs.stream_first_seen_table(stream, "v", table, out, scratch_dir(spark, "state"), "w").awaitTermination()
    assert sorted(values(spark.read.option("basePath", out).parquet(f"{out}/writer=*/batch_id=*"), "norm")) == sorted(want)
    more = jobs.stream_table(spark, incoming, rows.schema, 2)
    jobs.stream_first_seen_table(more, "v", table, scratch_dir(spark, "out"), scratch_dir(spark, "state"), "again").awaitTermination()
    assert table.read().count() == len(want)


def test_a_hot_key_is_folded_before_it_moves(spark):
    """Rows that a batch sends to the keyed step: at most one a key and task."""
    batch = spark.range(3_000).repartition(3).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("v"))
    table, out = jobs.seen_keys(spark, scratch_dir(spark, "seen"), 4), scratch_dir(spark, "out")
    sent = []
    firsts = jobs.first_of_batch(batch, "v")
    firsts.collect()

    def walk(node):
        if node.nodeName() == "Exchange" and "hashpartitioning(norm" in node.toString():
            sent.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            walk(node.plan())
        else:
            for i in range(node.children().size()):
                walk(node.children().apply(i))

    walk(firsts._jdf.queryExecution().executedPlan())
    assert len(sent) == 1 and firsts.count() <= sent[0] <= 3 * firsts.count() < 100
    assert table.unknown(firsts, "norm").count() == firsts.count() and out
