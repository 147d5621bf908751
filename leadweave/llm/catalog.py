"""Registered queries of the text operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm import (bpe, chat_format, decontaminate, html_extract, license_scan, line_dedup, mixing, parity_join, quality_rules,
                           resample, url_filter, vector_codes, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query(r"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT l.*, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM lines l LEFT JOIN owners o ON l.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents", "doc_id", "text"), labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query(r"""
WITH sized AS (SELECT doc_id, text, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source),
filling AS (
  SELECT *, 2.0 * source_size / weight AS full_at, row_number() OVER f AS step,
         (1.5 * (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(2.0 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / ((SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM sources WINDOW f AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)),
targets AS (SELECT source, source_size, least(2.0 * source_size, (SELECT arg_min(rate, step) FROM filling WHERE full_at >= rate) * weight)::DOUBLE AS target FROM filling),
drawn AS (
  SELECT doc_id, text, s.source, size, source_size, target, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS p,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END AS rank FROM drawn),
summed AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS left_over,
         sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS up_to FROM ranked)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((whole + CASE WHEN rank IS NOT NULL AND up_to - size / 2.0 <= left_over THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = parity_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return linked.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("first_word"), F.col("length").alias("n_words"), "similarity", "distance")


_CONTROL = "replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>')"


@query(f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length({_CONTROL.format("role")}) + length({_CONTROL.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(both, "conv_id long, turn long, role string, text string"))
    return chat_format.digests(chat_format.format_trees(chat_format.as_trees(turns))).withColumnRenamed("tree", "conv_id")


@query()
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    best = F.get("licenses", F.lit(0))
    return scanned.select("doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"), best["first_word"].alias("first_word"), best["last_word"].alias("last_word"),
                          F.array_sort(F.array_distinct(F.transform("licenses", lambda f: f["license"]))).alias("licenses"), F.col("licenses").alias("finds"))


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "url", "text", "n_chars")


@query()
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    fields = {"refers_to": "WARC-Refers-To", "refers_to_uri": "WARC-Refers-To-Target-URI", "refers_to_date": "WARC-Refers-To-Date", "source_payload_digest": "WARC-Source-Payload-Digest",
              "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}
    return records.select("page_id", "type", "record_id", *[F.element_at("headers", v).alias(k) for k, v in fields.items()], F.octet_length("block").cast("bigint").alias("content_length"),
                          F.sha2("block", 256).alias("block_sha256"))


@query()
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the tokenizer files' own package; the file is a parameter of the operator

    file = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_packed(table(spark, sf_dir, "documents", "doc_id", "text"), file)
    return coded.select("doc_id", (F.octet_length("packed_ids") / 4).cast("long").alias("n_tokens"), F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return drawn.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")


@query()
def op13_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), carry=("label",))
    books = hashlib.sha256(",".join(map(str, made.codebooks.ravel().tolist())).encode()).hexdigest()
    summed = vector_codes.with_group_error(made.rows, "label", "label_error")
    return summed.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books).alias("codebooks_sha256"))
