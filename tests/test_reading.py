import random

from pyspark.sql import functions as F

from leadweave.operators.lookup_cache import ask_domains, cached_lookup, result_table
from leadweave.session import scratch_dir
from leadweave.sources.lists import numbered_lines, target_list
from leadweave.sources.store import publish_ordered, scan_page
from tests.conftest import values


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def test_only_unknown_and_old_results_are_asked_for(spark):
    snapshot = spark.createDataFrame([("a", 1, "ok"), ("b", 0, "error"), ("late", 0, "timeout")], "domain string, n_mx int, outcome string")
    table, asked = result_table(spark, scratch_dir(spark, "results"), "domain", 4), []

    def run(day, *domains):
        def ask(keys):
            asked.append(sorted(values(keys, "domain")))
            return ask_domains(snapshot)(keys)

        rows = spark.createDataFrame([(d,) for d in domains], "d string")
        return {r.domain: (r.value, r.asked) for r in cached_lookup(rows, table, ask, at(day), "10 days").collect()}

    assert run(1, "a", "b", "late", "a", None) == {"a": (True, True), "b": (False, True), "late": (True, True)}
    assert run(3, "a", "late", "new") == {"a": (True, False), "late": (True, True), "new": (False, True)}
    assert run(12, "a", "new", "b") == {"a": (True, True), "new": (False, False), "b": (False, True)}
    assert asked == [["a", "b", "late"], ["late", "new"], ["a", "b"]]
    assert run(13) == {} and sorted(values(table.read(), "domain")) == ["a", "b", "new"]


def test_pages_of_the_ordered_table(spark):
    rng = random.Random(1)
    rows = [(f"id{i:04d}", f"u{i}", rng.randint(0, 30)) for i in range(400)]
    table = spark.createDataFrame(rows, "id string, source_url string, day int").select("id", "source_url", F.timestamp_seconds(F.col("day") * 86400).alias("created_at"))
    path = scratch_dir(spark, "ordered")
    publish_ordered(table.repartition(9), path, 6)
    want = [r.id for r in table.orderBy("created_at", "id").collect()]
    got, after = [], None
    while True:
        page = scan_page(spark, path, 70, after, table.schema)
        rows = page.collect()
        got += [r.id for r in rows]
        if not rows:
            break
        after = (rows[-1].created_at, rows[-1].id)
    assert got == want
    files = spark.read.parquet(f"{path}/borders").count()
    assert files > 2 and len(scan_page(spark, path, 5, None, table.schema).inputFiles()) == 1
    assert len(scan_page(spark, path, 5, (table.agg(F.min("created_at")).first()[0], "id0000"), table.schema).inputFiles()) <= 2


def test_lines_are_numbered_without_gaps(spark, tmp_path):
    lines = {name: [f"https://{name}.example/{i}" if i % 7 else ("# no" if i % 2 else "  ") for i in range(n)] for name, n in (("b", 4000), ("a", 3), ("c", 900), ("empty", 0))}
    for name, listed in lines.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(listed) + "\n")
    want = [x for name in sorted(lines) for x in lines[name] if x.startswith("https")]
    for size in ("2k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = numbered_lines(spark, str(tmp_path))
            assert [(r.ord, r.line) for r in got.orderBy("ord").collect()] == list(enumerate(want))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
    listed = spark.createDataFrame([(0, 0, "first")], "ord long, pos int, value string")
    assert values(target_list(listed, got).orderBy("source", "ord", "pos"), "value") == ["first", *want]
