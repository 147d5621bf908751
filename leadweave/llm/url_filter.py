"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes and confirmed by full digests.

A URL's host gives its suffixes at label borders, its path the prefixes that end in a slash, and the empty one. Each pair is one
expression. Rules are indexed by the digest of their host and of their path up to its last slash; expressions and rules
meet on the first eight hex digits, equal full digests and the rest of the rule's path confirm. Of the rules that fit, the
longest (host and path together, then host) wins; of equal ones, block wins.

Defined cases: a null url or one without ``://`` has an empty host and path. Rules without a host fit nothing. Repeated urls are
judged once and repeated rows all get the verdict. An empty table, or no rule at all, gives each page the default. Input columns
named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import ascii_lower, packed, unpacked

PREFIX_DIGITS = 8
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _slashed(path: str | Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def rule_index(rules: DataFrame) -> DataFrame:
    """``prefix, digest, rule_path, rule, length, host_length, verdict`` of ``host, path, verdict``."""
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("host"), path.alias("path"), "verdict").filter("host <> ''")
    # of a rule given twice, block holds
    single = named.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    rule = F.concat("host", "path")
    digest = F.sha2(F.concat("host", _slashed("path")), 256)
    return single.select(F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("digest"), F.col("path").alias("rule_path"), rule.alias("rule"),
                         F.char_length(rule).alias("length"), F.char_length("host").alias("host_length"), "verdict")


def expressions(urls: DataFrame, most_labels: int, longest_path: int) -> DataFrame:
    """``host, path, prefix, digest`` of every expression of ``host, path`` that some rule is long enough to match.

    Suffixes of more labels than any rule's host, and prefixes longer than any rule's path, can't fit and are not written out.
    """
    labels, steps = F.split("host", r"\."), F.split(F.substring("path", 1, longest_path), "/")
    short = urls.select("host", "path", F.slice(F.reverse(labels), 1, most_labels).alias("labels"), steps.alias("steps"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.reverse(F.slice("labels", 1, i)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("steps")), lambda i: F.array_join(F.concat(F.slice("steps", 1, i - 1), F.array(F.lit(""))), "/"))
    pairs = short.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("start"))
    hashed = pairs.select("host", "path", F.sha2(F.concat("suffix", "start"), 256).alias("digest"))
    return hashed.select("host", "path", F.substring("digest", 1, PREFIX_DIGITS).alias("prefix"), "digest")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, rule_verdict`` of the distinct ``host, path`` that some rule fits."""
    index = rule_index(rules)
    # two numbers from the rules: how far an expression has to go
    reach = index.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("labels"), F.max(F.char_length("rule_path")).alias("path")).first()
    made = expressions(urls.filter("host <> ''").distinct(), reach["labels"] or 0, reach["path"] or 0)
    met = made.join(index.withColumnRenamed("digest", "full"), "prefix").filter((F.col("digest") == F.col("full")) & F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct("length", "host_length", "rule", "verdict")).alias("best")
    return met.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with ``host, path, rule, verdict``; ``rules`` is ``host, path, verdict``."""
    rows = packed(pages, url=url_col).select("row", url_host("url").alias("host"), url_path("url").alias("path"))
    found = rows.join(judged(rows.select("host", "path"), rules), ["host", "path"], "left")
    return unpacked(found, pages, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=F.coalesce("rule_verdict", F.lit(default)))
