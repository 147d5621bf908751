import csv
import glob
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog import table_queries
from leadweave.operators.lookups import verify_handles
from leadweave.operators.summary import column_widths
from leadweave.session import scratch_dir
from leadweave.sources import store
from leadweave.sources.export import CSV_OPTIONS, flatten_leads, write_leads
from leadweave.sources.lists import clean_lines, list_items, read_lines, target_list
from leadweave.sources.store import WRITES, append_writes, fold_state, folded, id_clashes, known_urls, merge_states, publish, read_published, read_writes, scan_leads, stored_rows, upsert_fold
from leadweave.streaming import jobs
from tests.conftest import values

LEAD = "id string, source_url string, company_name string, raw_name string, contacts struct<emails:array<string>,skype:array<string>,discord:array<string>,linkedin:array<string>,twitter:array<string>,telegram:array<string>>, is_cis boolean, cis_reason string, mx_valid boolean"


def lead(spark, id_, url, company, emails=(), telegram=(), linkedin=(), flag=True, reason=""):
    row = (id_, url, company, company, (list(emails), [], [], list(linkedin), [], list(telegram)), flag, reason, True)
    return verify_handles(spark.createDataFrame([row], LEAD).coalesce(1)).withColumn("created_at", F.to_timestamp(F.lit("1970-01-01 00:00:00")))


def test_two_writes_to_one_url(spark):
    log, table, url = scratch_dir(spark, "log"), scratch_dir(spark, "table"), "https://example.com/lead"
    first = lead(spark, "lead-1", url, "Example", ["first@example.com"], ["example"], ["example-company"], True, "test")
    second = lead(spark, "different-id", url, "Updated", ["updated@example.com"], reason="")
    append_writes(stored_rows(first, F.lit(1)), log, "w", 0)
    append_writes(stored_rows(second, F.lit(2)), log, "w", 1)
    append_writes(stored_rows(second, F.lit(2)), log, "w", 1)  # a replay
    publish(upsert_fold(read_writes(spark, log)), table)
    got = scan_leads(read_published(spark, table), flagged_only=True).collect()
    assert [(r.id, r.company_name, r.raw_name, r.emails, r.linkedin, r.telegram_handles, r.cis_reason, r.source_domain) for r in got] == [
        ("lead-1", "Updated", "Updated", ["updated@example.com"], ["example-company"], ["example"], "test", "example.com")]
    assert [(t.username, t.status) for t in got[0].tg_results] == [("example", "SKIPPED")]
    assert values(known_urls(read_published(spark, table)), "source_url") == [url]
    plan = read_published(spark, table).filter("is_cis")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_cis" in plan


def test_fold_against_the_statement_and_itself(spark):
    rng = random.Random(2)
    texts = ("company_name", "emails", "telegram_handles", "tg_validation_status", "skype", "linkedin", "twitter", "cis_reason")
    rows, want = [], {}
    for seq in range(300):
        row = {f.name: None for f in WRITES.fields} | {c: rng.choice(["", f"{c}{seq}"]) for c in texts}
        row |= {"seq": seq, "id": f"i{seq}", "source_url": f"u{rng.randint(0, 20)}", "source_domain": "d", "is_cis": rng.random() > 0.5, "mx_valid": rng.random() > 0.5}
        rows.append(tuple(row[f.name] for f in WRITES.fields))
        old = want.get(row["source_url"])
        new = dict(row)
        if old:
            new |= {"id": old["id"]} | {c: row[c] or old[c] for c in texts}
        want[row["source_url"]] = new
    columns = ("source_url", "id", *texts, "is_cis", "mx_valid")
    df = spark.createDataFrame(rows, WRITES)
    for parts in (1, 17):
        rows = upsert_fold(df.repartition(parts))
        assert sorted(values(rows, *columns)) == sorted(tuple(w[c] for c in columns) for w in want.values())
    whole = upsert_fold(df)
    halves = [fold_state(df.filter(F.col("seq") % 2 == half)) for half in (0, 1)]
    again = folded(merge_states(merge_states(halves[0].unionByName(halves[1])).unionByName(halves[0])))
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    tied = df.withColumn("seq", F.lit(1).cast("long"))
    assert sorted(map(str, upsert_fold(tied).collect())) == sorted(map(str, upsert_fold(tied.orderBy(F.rand(4)).repartition(9)).collect()))
    assert values(id_clashes(df.filter("seq < 2").withColumn("id", F.lit("i"))), "n_urls") in ([2], [])


def test_exports(spark):
    one = lead(spark, "lead-1", " https://acme.example ", 'Ac"me,\nLtd', ["one@acme.example", "two@acme.example"], ["acme"], reason="test reason")
    base = scratch_dir(spark, "out")
    write_leads(one, base + ".csv")
    with open(glob.glob(base + ".csv/part-*")[0], newline="") as f:
        header, row = list(csv.reader(f))
    assert header[0] == "ID" and len(header) == 13
    assert row[2] == " https://acme.example " and row[1] == 'Ac"me,\nLtd' and row[3] == "one@acme.example, two@acme.example" and row[5] == "@acme:[SKIPPED]" and row[10] == "true" and row[12] == "1970-01-01 00:00:00"
    assert values(spark.read.options(**CSV_OPTIONS).csv(base + ".csv"), "*") == [tuple(row)]
    write_leads(one, base + ".JSON")
    with open(glob.glob(base + ".JSON/part-*")[0]) as f:
        back = json.loads(f.readline())
    assert back["contacts"]["emails"] == ["one@acme.example", "two@acme.example"] and back["tg_results"][0]["status"] == "SKIPPED" and "user_id" not in back["tg_results"][0] and "checked_at" in back["tg_results"][0]
    assert set(back) <= {"id", "source_url", "company_name", "raw_name", "contacts", "tg_results", "network_metadata", "is_cis", "cis_reason", "mx_valid", "created_at"}
    write_leads(one, base + ".parquet")
    assert spark.read.parquet(base + ".parquet").count() == 1
    for path in (base + ".xlsx", base + ".txt", base):
        with pytest.raises(ValueError):
            write_leads(one, path)
    assert values(column_widths(flatten_leads(one)).orderBy("pos"), "width")[:4] == [14, 14, 24, 36]


def test_lines_from_a_file(spark, tmp_path):
    path = tmp_path / "targets.txt"
    path.write_text("  https://a.example \n\n# no\n https://b.example \nhttps://a.example\n", encoding="utf8")
    assert [r.line for r in read_lines(spark, str(path)).orderBy("file", "block", "row").collect()] == ["https://a.example", "https://b.example", "https://a.example"]
    listed = list_items(spark.createDataFrame([(0, "x, y")], "ord int, v string"), "v", ["ord"])
    both = target_list(listed, read_lines(spark, str(path))).orderBy("source", "file", "block", "ord", "pos")
    assert values(both, "value") == ["x", "y", "https://a.example", "https://b.example", "https://a.example"]
    assert clean_lines(spark.createDataFrame([("#x",), (" ",)], "line string")).count() == 0


def test_streams_equal_the_batch(spark):
    incoming, out = scratch_dir(spark, "incoming"), scratch_dir(spark, "out")
    rows = spark.range(60).select((F.col("id") % 25).cast("string").alias("v"), F.col("id").alias("ord"))
    rows.repartition(4).write.parquet(incoming)
    stream = jobs.stream_table(spark, incoming, rows.schema, 1)
    jobs.stream_to_files(jobs.stream_first_seen(stream, "v"), out, scratch_dir(spark, "state")).awaitTermination()
    assert spark.read.parquet(out).count() == 25
    stamped = stream.withColumn("at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    bounded = scratch_dir(spark, "out")
    jobs.stream_to_files(jobs.stream_first_seen(stamped, "v", event_time="at", forget_after="1 hour").drop("at"), bounded, scratch_dir(spark, "state")).awaitTermination()
    assert spark.read.parquet(bounded).count() == 25


def test_files_of_the_log_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LOG_ROWS", 10)
    store.append_writes(spark.range(95).coalesce(1), str(tmp_path / "log"), "w", 0)
    files = spark.read.parquet(str(tmp_path / "log")).groupBy(F.input_file_name()).count()
    assert sorted(values(files, "count")) == [5] + [10] * 9


@pytest.mark.parametrize("name, batches", [("q_stream_upsert", 3), ("q_two_writers", 4)])
def test_no_task_holds_a_whole_batch(spark, tmp_path, name, batches):
    orders = spark.range(0, 4_000, 1, 8).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS o_orderdate")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = getattr(table_queries, name)(spark, str(tmp_path))
    files = Counter(f.rsplit("/", 1)[0] for f in got.inputFiles())
    assert len(files) == batches and min(files.values()) > 1
    assert sorted(got.collect()) == sorted(table_queries.q_lead_upsert(spark, str(tmp_path)).collect())
